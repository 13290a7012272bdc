"""Text normalisation as Column functions, all of them Catalyst expressions.

NFKD and emoji aliases have no built-in. Characters that become one character go through ``translate``.
Emoji sequences and characters that become several are found by one pattern; the text is cut there,
each find is looked up in a constant map (Hangul syllables are computed), and the parts are joined again.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from commentlens.functions import emoji
from commentlens.functions.lookfold import fold_map

# Fixed value: characters whose repeats are collapsed.
BUFFER_CHARS = "*_~|`[]()'-.•,"

# Fixed value: Unicode categories that are stripped.
STRIPPED_CATEGORIES = ("Mn", "Cc", "Cf", "Cs", "Co", "Cn", "Sk")

#: What the strip, NFKD and the folds may change: anything but printable ASCII, and the two ASCII modifier symbols.
NOT_PLAIN = r"[^\x20-\x5D\x5F\x61-\x7E]"
#: The same for the live profile, which keeps single white space of any kind.
NOT_PLAIN_LIVE = r"[^\x09-\x0D\x20-\x5D\x5F\x61-\x7E]"

_BUFFER_PATTERN = r"([*_~|`\[\]()'\-.•,])\1+"
_NON_ASCII = r"[^\x00-\x7F]"


def regex_ranges(codes) -> str:
    """Code points as the inside of a Java character class, runs merged."""
    parts, codes = [], sorted(set(codes))
    start = prev = None
    for code in [*codes, None]:
        if prev is not None and code == prev + 1:
            prev = code
            continue
        if prev is not None:
            parts.append(rf"\x{{{start:X}}}" if start == prev else rf"\x{{{start:X}}}-\x{{{prev:X}}}")
        start = prev = code
    return "".join(parts)


def _latin1_first(low, high: str) -> str:
    """Class of the Latin-1 codes ``low`` and of what ``high`` matches beyond Latin-1.

    Single Latin-1 characters compile to a bit set, and other Latin-1 text never reaches ``high``.
    """
    return "[" + "".join(rf"\x{c:02X}" for c in low) + rf"[[^\x00-\xFF]&&[{high}]]]"


def sparse_class(codes) -> str:
    """Regex class for one of ``codes``."""
    codes = sorted(codes)
    return _latin1_first([c for c in codes if c <= 0xFF], regex_ranges(c for c in codes if c > 0xFF))


def _covering(codes, n_ranges: int = 8) -> str:
    """Class content that holds all ``codes``: those of Latin-1 one by one, the others in ``n_ranges`` ranges split at the widest gaps."""
    codes = sorted(set(codes))
    low, high = [c for c in codes if c <= 0xFF], [c for c in codes if c > 0xFF]
    gaps = sorted(range(1, len(high)), key=lambda i: high[i - 1] - high[i])[:n_ranges - 1]
    ends = [0, *sorted(gaps), len(high)]
    return "".join(rf"\x{c:02X}" for c in low) + "".join(rf"\x{{{high[i]:X}}}-\x{{{high[j - 1]:X}}}" for i, j in zip(ends, ends[1:], strict=False) if j > i)


#: The parts that Hangul syllables are made of, in the order of their code.
_FIRST_JAMO, _MIDDLE_JAMO, _LAST_JAMO = ((0x1100, 19), (0x1161, 21), (0x11A8, 27))
_SYLLABLES = (0xAC00, 0xD7A3)
_TONES = "[\\x{1F3FB}-\\x{1F3FF}]"
_FLAGS = "".join(chr(c) for c in range(0x1F1E6, 0x1F200))


@lru_cache(maxsize=2)
def _tables(live: bool = False) -> tuple[dict[str, str], dict[str, str], str]:
    """(one-to-one map, map of the others, pattern of the others).

    The first equals NFKD plus look-alike folding once marks are gone. The live profile keeps marks
    that are no diacritics, so letters with such a mark become several characters there.
    """
    import regex

    folds = fold_map()
    kept_mark = regex.compile(r"[\p{Mn}--\p{Diacritic}]", regex.V1)
    every = "".join(chr(c) for c in range(0x80, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000)
    emojis = set(regex.findall(r"\p{Emoji}", every))
    single, several = {}, {c: emoji.alias(c) for c in emojis}
    for char in every:
        full = unicodedata.normalize("NFKD", char)
        if char in emojis or (full == char and char not in folds) or _SYLLABLES[0] <= ord(char) <= _SYLLABLES[1]:
            continue
        whole = "".join(folds.get(c, c) for c in full)
        base = "".join(folds.get(c, c) for c in full if unicodedata.category(c) != "Mn")
        if len(base) == 1 and not (live and full != char and kept_mark.search(full)):
            single[char] = base
        elif whole != char:
            several[char] = whole
    spread = [*(ord(c) for c in several if c not in emojis), *range(_SYLLABLES[0], _SYLLABLES[1] + 1)]
    # a few wide ranges turn nearly all other characters away before the long classes
    pattern = (
        rf"[0-9#*]\uFE0F?\u20E3|(?=[{_covering([*spread, *map(ord, emojis), *map(ord, _FLAGS)])}])"
        rf"(?:[{_FLAGS[0]}-{_FLAGS[-1]}]{{2}}|{sparse_class(map(ord, emojis))}\uFE0F?|{sparse_class(spread)})"
    )
    return single, several, pattern


_STRIP_PATTERN = _latin1_first(
    [c for c in range(0x100) if unicodedata.category(chr(c)) in STRIPPED_CATEGORIES],
    "".join(rf"\p{{{c}}}" for c in STRIPPED_CATEGORIES),
)


def _translate(text: Column, mapping: dict[str, str]) -> Column:
    return F.translate(text, "".join(mapping), "".join(mapping.values()))


def collapse_whitespace(text: Column) -> Column:
    """Trim, and turn every run of whitespace into one space."""
    # a single space is no match
    return F.trim(F.regexp_replace(text, r"(?U)[\s&&[^ ]]\s*| \s+", " "))


def collapse_long_spaces(text: Column) -> Column:
    """Trim, and turn runs of two or more whitespace characters into one space."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), r"(?U)\s\s+", " ")


def strip_categories(text: Column) -> Column:
    """Remove marks, control, format, surrogate, private, unassigned and modifier symbols."""
    return F.regexp_replace(text, _STRIP_PATTERN, "")


def collapse_buffer_runs(text: Column) -> Column:
    """Repeats of one buffer character become a single one."""
    return F.regexp_replace(text, _BUFFER_PATTERN, "$1")


def fold_lookalikes(text: Column) -> Column:
    """Replace look-alike letters by ASCII; case-sensitive."""
    table = fold_map()
    single = {k: v for k, v in table.items() if len(v) == 1}
    multi = {k: v for k, v in table.items() if len(v) > 1}
    spelled = text
    for char, target in multi.items():
        spelled = F.replace(spelled, F.lit(char), F.lit(target))
    folded = F.when(text.rlike("[" + "".join(multi) + "]"), spelled).otherwise(text)
    return F.when(text.rlike(_NON_ASCII), _translate(folded, single)).otherwise(text)


def _constant_map(table: dict[str, str]) -> Column:
    return F.from_json(F.lit(json.dumps(table)), "map<string,string>")


def _syllable(char: Column) -> Column:
    """The parts of a Hangul syllable."""
    folds = fold_map()
    first, middle, last = (F.lit("".join(folds.get(chr(c), chr(c)) for c in range(low, low + n))) for low, n in (_FIRST_JAMO, _MIDDLE_JAMO, _LAST_JAMO))
    number = F.ascii(char) - _SYLLABLES[0]
    part = lambda jamo, at: F.substr(jamo, at.cast("int") + 1, F.lit(1))
    ending = F.when(number % 28 > 0, part(last, number % 28 - 1)).otherwise("")
    return F.concat(part(first, F.floor(number / 588)), part(middle, F.floor((number % 588) / 28)), ending)


def _spelt(found: Column, several: dict[str, str]) -> Column:
    """What one find of the pattern becomes."""
    head = F.substring(found, 1, 1)
    keycaps = _constant_map(emoji.KEYCAPS)
    flag = F.concat(F.lit(":flag_"), F.translate(found, _FLAGS, "abcdefghijklmnopqrstuvwxyz"), F.lit(":"))
    return (
        F.when(F.endswith(found, F.lit("\u20E3")), F.concat(F.lit(":"), F.try_element_at(keycaps, head), F.lit(":")))
        .when(found.rlike(f"^[{_FLAGS}]{{2}}$"), flag)
        .when(found.rlike(_TONES), found)
        .when(head.between(chr(_SYLLABLES[0]), chr(_SYLLABLES[1])), _syllable(head))
        .otherwise(F.try_element_at(_constant_map(several), head))
    )


def decompose(text: Column, live: bool = False) -> Column:
    """Emoji aliases, NFKD and look-alike folding, up to characters that the profile removes next.

    The live profile drops skin tones. ``text`` appears several times in the result, so pass a plain column.
    """
    single, several, pattern = _tables(live)
    if live:
        text = F.regexp_replace(text, _TONES, "")
    spelt = F.transform(F.regexp_extract_all(text, F.lit(pattern), 0), lambda found: _spelt(found, several))
    joined = F.array_join(F.zip_with(F.split(text, pattern), spelt, lambda p, e: F.concat(p, F.coalesce(e, F.lit("")))), "")
    return _translate(F.when(text.rlike(pattern), joined).otherwise(text), single)


def normalise(text: Column) -> Column:
    """The full chain: aliases, NFKD, fold, strip, whitespace, buffer runs, lower case.

    ASCII text skips the per-character steps. Pass a plain column.
    """

    def finish(folded: Column) -> Column:
        return F.lower(collapse_buffer_runs(collapse_whitespace(strip_categories(folded))))

    return F.when(text.rlike(_NON_ASCII), finish(decompose(text))).otherwise(finish(text))


def normalise_browser(text: Column) -> Column:
    """The live variant: skin tones dropped, only accents stripped, buffer runs kept."""

    def finish(folded: Column) -> Column:
        return F.lower(collapse_long_spaces(F.regexp_replace(folded, DIACRITICS, "")))

    return F.when(text.rlike(_NON_ASCII), finish(decompose(text, live=True))).otherwise(finish(text))


def _diacritics() -> str:
    import regex

    mark = regex.compile(r"\p{Diacritic}")
    return sparse_class([c for c in range(0x20000) if mark.match(chr(c))])


DIACRITICS = _diacritics()


def pair_text(author: Column, text: Column) -> Column:
    """Model input: ``<author> commented <text>``, both normalised."""
    return F.concat(normalise(author), F.lit(" commented "), normalise(text))


def surface_form(text: Column) -> Column:
    """Author names as the letter rules see them: whitespace first, then the category strip."""
    return strip_categories(collapse_whitespace(text))


def surface_text(text: Column) -> Column:
    """Comment text as the letter rules see it: whitespace, buffer runs, then the category strip."""
    return strip_categories(collapse_buffer_runs(collapse_whitespace(text)))
