"""Emoji to ``:alias:`` text, from Unicode names, for use inside Arrow tasks."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

# Aliases that differ from the Unicode name.
ALIASES = {
    "☝": "point_up",
    "⬆": "arrow_up",
    "▶": "arrow_forward",
    "🎁": "gift",
    "👆": "point_up_2",
    "👇": "point_down",
    "👈": "point_left",
    "👉": "point_right",
}

# Key-cap names.
KEYCAPS = {
    "#": "hash", "*": "asterisk", "0": "zero", "1": "one", "2": "two", "3": "three",
    "4": "four", "5": "five", "6": "six", "7": "seven", "8": "eight", "9": "nine",
}

# key-cap sequence | flag pair | one emoji with an optional presentation selector
PATTERN = (
    r"[0-9#*]\uFE0F?\u20E3"
    r"|[\U0001F1E6-\U0001F1FF]{2}"
    r"|(?![0-9#*])\p{Emoji}\uFE0F?"
)


@lru_cache(maxsize=1)
def _compiled():
    import regex

    return regex.compile(PATTERN)


@lru_cache(maxsize=8192)
def alias(sequence: str) -> str:
    head = sequence[0]
    if head in KEYCAPS:
        name = KEYCAPS[head]
    elif "\U0001F1E6" <= head <= "\U0001F1FF" and len(sequence) == 2:
        name = "flag_" + "".join(chr(ord(c) - 0x1F1E6 + ord("a")) for c in sequence)
    else:
        name = ALIASES.get(head) or unicodedata.name(head, "emoji").lower()
    return ":" + name.replace(" ", "_").replace("-", "_") + ":"


@lru_cache(maxsize=1)
def _skin_tones():
    import regex

    return regex.compile("[\U0001F3FB-\U0001F3FF]")


def demojize(text: str, drop_skin_tones: bool = False) -> str:
    """Skin-tone modifiers are kept as they are unless dropped; they never become aliases."""
    if drop_skin_tones:
        text = _skin_tones().sub("", text)
    return _compiled().sub(
        lambda m: m.group() if "\U0001F3FB" <= m.group()[0] <= "\U0001F3FF" else alias(m.group()), text
    )
