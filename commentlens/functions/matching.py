"""Combo, phrase and glyph tests as Column predicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from commentlens.functions import rulebook


def _item(text: Column, item: str) -> Column:
    if item.startswith("re:"):
        return text.rlike(item[3:])
    if item.startswith("~"):
        return ~text.contains(item[1:])
    return text.contains(item)


def combo(text: Column, items) -> Column:
    """Every item holds."""
    return reduce(lambda a, b: a & b, (_item(text, i) for i in items))


def any_combo(text: Column, combos) -> Column:
    """Some combo holds on one text."""
    return reduce(lambda a, b: a | b, (combo(text, c) for c in combos), F.lit(False))


def any_pair_combo(author: Column, text: Column, combos) -> Column:
    """Some (author items, text items) combo holds on the pair."""
    tests = (combo(author, a) & combo(text, t) for a, t in combos)
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def contains_any(text: Column, phrases) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(p) for p in phrases), F.lit(False))


def _beyond_ascii(glyphs: str) -> str:
    # ASCII and accented Latin fail the first set at once instead of being tried against every glyph
    return rf"[[^\x00-\x7F\xC0-\xFF]&&[{glyphs}]]"


_DIGIT = _beyond_ascii(rulebook.STYLED_DIGITS)
_PLUS, _ONE = _beyond_ascii(rulebook.STYLED_PLUS), _beyond_ascii(rulebook.STYLED_ONE)


def _has_styled(text: Column) -> Column:
    """Styled digits and signs lie beyond Latin-1, but for the plus-minus sign."""
    return text.rlike(r"[^\x00-\xB0\xB2-\xFF]")


def styled_digit_count(text: Column) -> Column:
    return F.when(_has_styled(text), F.regexp_count(text, F.lit(_DIGIT))).otherwise(0)


def has_styled_digits(text: Column, minimum: int = rulebook.STYLED_DIGIT_MINIMUM) -> Column:
    return styled_digit_count(text) >= minimum


def has_disguised_phone(text: Column) -> Column:
    """A plus and a one next to each other, at least one of them disguised."""
    return _has_styled(text) & (text.rlike(rf"{_PLUS} ? ?(?:1|{_ONE})") | text.rlike(rf"[+] ? ?{_ONE}"))


def filled_phrases(text: Column, phrases) -> Column:
    """Any of the filler patterns; their first letters are tested before the patterns are tried."""
    if not phrases:
        return F.lit(False)
    firsts = "".join(sorted({p[0] for p in phrases}))
    return text.rlike(f"(?=[{firsts}])(?:{'|'.join(phrases)})")
