"""URL tests. The pattern is assembled from the public-host grammar it accepts.

Java and RE2 need different spellings of the same language: Java gets possessive labels and
DNS-bounded tails so that a 20,000-character host cannot exhaust the stack.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WIDE = r"\x{A1}-\x{FFFF}"
_WORD = rf"a-z{_WIDE}\x{{10000}}-\x{{10FFFF}}"

_MIDDLE = r"(?:\.(?:1?\d{1,2}|2[0-4]\d|25[0-5]))"
_LAST = r"(?:\.(?:0|[1-9]\d?|1\d\d|2[0-4]\d|25[0-5]))"
_BYTE = r"(?:25[0-5]|(?:2[0-4]|1?[0-9])?[0-9])"
_DOTTED = rf"(?:{_BYTE}\.){{3}}{_BYTE}"
_HEX = "[0-9a-f]{1,4}"

HOST_CLASSES = ("private_ip", "private_host", "public_ip", "ipv6", "name")


def _ipv6() -> str:
    forms = [rf"(?:{_HEX}:){{7}}{_HEX}", rf"(?:{_HEX}:){{1,7}}:"]
    forms += [rf"(?:{_HEX}:){{1,{7 - n}}}(?::{_HEX}){{1,{n}}}" for n in range(1, 7)]
    forms += [
        rf":(?:(?::{_HEX}){{1,7}}|:)",
        r"fe80:(?::[0-9a-f]{0,4}){0,4}%[0-9a-z]+",
        rf"::(?:ffff(?::0{{1,4}})?:)?{_DOTTED}",
        rf"(?:{_HEX}:){{1,4}}:{_DOTTED}",
    ]
    return r"\[(?:" + "|".join(forms) + r")\]"


def _name(java: bool) -> str:
    hold = "+" if java else ""
    few, many = ("{0,31}", "{0,126}") if java else ("*", "*")
    label = rf"(?:xn---{{0,2}})?[{_WORD}0-9]+{hold}(?:-[{_WORD}0-9]+{hold}){few}{hold}"
    top = rf"\.(?:xn---{{0,2}}[{_WORD}0-9]{{2,}}|[{_WORD}]{{2,}})"
    return rf"{label}(?:\.{label}){many}{top}"


def _hosts(java: bool) -> dict[str, str]:
    return {
        "private_ip": rf"(?:10|127){_MIDDLE}{{2}}{_LAST}|(?:169\.254|192\.168){_MIDDLE}{_LAST}"
                      rf"|172\.(?:1[6-9]|2\d|3[0-1]){_MIDDLE}{_LAST}",
        "private_host": "localhost",
        "public_ip": rf"(?:[1-9]\d?|1\d\d|2[01]\d|22[0-3]){_MIDDLE}{{2}}{_LAST}",
        "ipv6": _ipv6(),
        "name": _name(java),
    }


def _prefix(java: bool) -> str:
    hold = "+" if java else ""
    return rf"(?i)(?:https?|ftp)://(?:[-a-z{_WIDE}0-9._~%!$&'()*+,;=:]+{hold}@)?"


def url_pattern(java: bool = True) -> str:
    hosts = "|".join(_hosts(java).values())
    path = rf"(?:/[-{_WORD}0-9._~%!$&'()*+,;=:@/]*)?"
    return rf"{_prefix(java)}(?:{hosts})(?::\d{{2,5}})?{path}(?:\?\S*)?(?:#\S*)?"


def host_patterns(java: bool = True) -> dict[str, str]:
    """Anchored pattern per host class, in order of precedence."""
    return {name: rf"^{_prefix(java)}(?:{host})" for name, host in _hosts(java).items()}


URL_PATTERN = url_pattern()


def first_url(text: Column) -> Column:
    """The first URL, or the empty string. Text without ``://`` skips the pattern."""
    return F.when(text.contains("://"), F.regexp_extract(text, URL_PATTERN, 0)).otherwise("")


def contains_url(text: Column) -> Column:
    return text.contains("://") & text.rlike(URL_PATTERN)


def is_only_url(text: Column) -> Column:
    """The first match spans the whole text."""
    return (first_url(text) == text) & (text != "")


def host_class(text: Column) -> Column:
    """Kind of host in the first URL; NULL without one."""
    url = first_url(text)
    kinds = F.lit(None).cast("string")
    for name, pattern in reversed(host_patterns().items()):
        kinds = F.when(url.rlike(pattern), name).otherwise(kinds)
    return F.when(url != "", kinds)


def is_absolute_url(text: Column) -> Column:
    """A scheme, a colon and something after it."""
    return text.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:")
