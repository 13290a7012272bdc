"""What the live profile reads from page markup and links.

Tags may quote their attributes either way or not at all, and quoted values may hold ``>``. Everything is
regular expressions and array functions in the JVM.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: timestamp links; the pattern keeps the escaped ampersand it was written with.
TIMESTAMP_LINK = r"/watch\?v=[0-9A-Za-z_-]{11}&amp;t=\d+"

# Fixed value: what a channel address begins with.
CHANNEL_PREFIX = "https://www.youtube.com/channel/"

# Fixed value: class of the anchors that a comment body links with.
BODY_LINK_CLASS = "yt-simple-endpoint"

# what stands between the name of a tag and its end
_INSIDE = r"""(?:[^>"']|"[^"]*"|'[^']*')*"""
_VALUE = r"""\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
# a name is an attribute's where it follows space, a slash or a closing quote
_NAMED = r"""(?<=[\s/"'])"""
_ANCHOR = rf"(?is)<a(?=[\s/>]){_INSIDE}>"
_IMAGE = rf"(?is)<img(?=[\s/]){_INSIDE}?{_NAMED}alt{_VALUE}{_INSIDE}>"
_UNSEEN = r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>"
# a tag whose quotes do not match up ends at the first bracket
_TAG = rf"(?s)<[A-Za-z/!?]{_INSIDE}>|<[A-Za-z/!?][^>]*>"
_ENTITY = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,10});"
# named references of HTML 4, and the one that XML adds
_NAMES = {f"&{name};": chr(code) for name, code in name2codepoint.items()} | {"&apos;": "'"}
# references to control codes mean the characters that Windows has there
_WINDOWS = {code: bytes([code]).decode("cp1252") for code in range(0x80, 0xA0) if code not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute of one tag, whatever its quotes; NULL if the tag lacks it. Of repeats the first counts."""
    pattern = rf"(?is)^<\w+{_INSIDE}?{_NAMED}{name}{_VALUE}"
    found = F.regexp_extract(tag, pattern, 0)
    return F.when(found != "", decode_entities(F.regexp_replace(found, pattern, "$1$2$3"), escaped_ampersand=True))


def _character(code: Column) -> Column:
    """The character with a code point; what is no character becomes U+FFFD."""
    windows = F.create_map(*(F.lit(x) for pair in _WINDOWS.items() for x in pair))
    valid = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    spelt = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return F.when(~valid | code.isNull(), "\uFFFD").when(code.between(0x80, 0x9F), F.coalesce(F.element_at(windows, code.cast("int")), spelt)).otherwise(spelt)


def _decoded(reference: Column) -> Column:
    names = F.create_map(*(F.lit(x) for pair in _NAMES.items() for x in pair))
    hexadecimal = F.conv(F.regexp_extract(reference, "^&#[xX]([0-9a-fA-F]+);$", 1), 16, 10).cast("bigint")
    decimal = F.regexp_extract(reference, "^&#([0-9]+);$", 1)
    return (
        F.when(reference.rlike("^&#[xX]"), _character(hexadecimal))
        .when(reference.startswith("&#"), _character(decimal.try_cast("bigint")))
        .otherwise(F.coalesce(F.element_at(names, reference), reference))
    )


def decode_entities(text: Column, escaped_ampersand: bool = False) -> Column:
    """Character references become characters, each once; unknown names stay. ``escaped_ampersand`` keeps ``&amp;`` as it is."""
    found = F.regexp_extract_all(text, F.lit(_ENTITY), 0)
    seen = F.transform(found, lambda e: F.when(e == "&amp;", e).otherwise(_decoded(e)) if escaped_ampersand else _decoded(e))
    between = F.split(text, _ENTITY)
    joined = F.array_join(F.zip_with(between, seen, lambda p, e: F.concat(p, F.coalesce(e, F.lit("")))), "")
    return F.when(F.contains(text, F.lit("&")), joined).otherwise(text)


def anchors(html: Column, css_class: str | None = None) -> Column:
    """Start tags of all anchors, or of those with a class, in document order."""
    tags = F.regexp_extract_all(html, F.lit(_ANCHOR), 0)
    if css_class is None:
        return tags
    return F.filter(tags, lambda t: F.array_contains(F.split(F.coalesce(attribute(t, "class"), F.lit("")), r"\s+"), css_class))


def link_targets(html: Column, css_class: str | None = None) -> Column:
    """Targets of all anchors that have one, in document order. The ampersand of a target stays escaped."""
    return F.filter(F.transform(anchors(html, css_class), lambda t: attribute(t, "href")), lambda h: h != "")


def has_clickable_link(html: Column, css_class: str | None = None) -> Column:
    """The first anchor (of a class) with a target exists and is not a timestamp link."""
    first = F.try_element_at(link_targets(html, css_class), F.lit(1))
    return first.isNotNull() & ~first.rlike(TIMESTAMP_LINK)


def visible_text(html: Column) -> Column:
    """Text nodes plus image ``alt`` text, character references decoded; scripts, styles and comments do not count."""
    kept = F.regexp_replace(html, _UNSEEN, "")
    alts = F.regexp_replace(kept, _IMAGE, "$1$2$3")
    return decode_entities(F.regexp_replace(alts, _TAG, ""))


def query_parameter(url: Column, name: str) -> Column:
    """Value of a query parameter; NULL when the URL is malformed or lacks it."""
    return F.try_parse_url(url, F.lit("QUERY"), F.lit(name))


def channel_id(profile_url: Column) -> Column:
    return F.replace(profile_url, F.lit(CHANNEL_PREFIX), F.lit(""))


def permalink(video_id: Column, comment_id: Column) -> Column:
    return F.concat(F.lit("https://www.youtube.com/watch?v="), video_id, F.lit("&lc="), comment_id)


def display_text(author_name: Column, text: Column) -> Column:
    return F.concat(F.lit("["), author_name, F.lit("] "), text)
