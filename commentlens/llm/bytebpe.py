"""Byte-level BPE by rank-synchronous array merging.

Texts are cut into pre-tokens on arrays of code points. Different pre-tokens lie one after another in
one flat array of symbols with the number of their sequence beside them (a ragged array). In each
round every sequence merges its pair of lowest rank, at all its places, and sequences without a known
pair leave. A task remembers pre-tokens that it has merged, within a bound.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
from tokenizers import pre_tokenizers

#: Characters that are cut at a time; longer texts are cut where no token can cross.
SLICE_CHARS = 1 << 20
#: Pre-tokens that a task remembers.
MEMO_SIZE = 1 << 19
_LETTER, _NUMBER, _OTHER, _SPACE = 1, 2, 3, 4
_NO_RANK = np.int64(1) << 40


def _byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte: itself if printable, else the next from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


@dataclass
class Vocabulary:
    """What merging needs of a tokenizer file; small enough to broadcast, as it does not grow with the data."""

    first: np.ndarray  # id of each byte
    joined: np.ndarray  # whether a token holds one byte before another
    slots: np.ndarray  # hash table of pairs, left * 2^32 + right, with open addressing
    ranks: np.ndarray
    merged: np.ndarray
    token_bytes: list[bytes]
    specials: list[str]

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged id of each pair; pairs that do not merge have the rank above all."""
        keys = (left << 32) + right
        at = _slot(keys, len(self.slots))
        open_ = np.flatnonzero((self.slots[at] != keys) & (self.slots[at] >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) % len(self.slots)
            found = self.slots[at[open_]]
            open_ = open_[(found != keys[open_]) & (found >= 0)]
        return np.where(self.slots[at] == keys, self.ranks[at], _NO_RANK), self.merged[at]


def _slot(keys: np.ndarray, size: int) -> np.ndarray:
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % size


def load_vocabulary(path: str) -> Vocabulary:
    """Reads a byte-level BPE ``tokenizer.json``; a file with other steps is refused."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, cut = spec["model"], spec["pre_tokenizer"] or {}
    odd = [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
    if model["type"] != "BPE" or spec["normalizer"] or cut.get("type") != "ByteLevel" or cut["add_prefix_space"] or not cut.get("use_regex", True) or odd:
        raise ValueError(f"{path} is not a plain byte-level BPE")
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] or not t["special"] for t in spec["added_tokens"]):
        raise ValueError(f"{path} has added tokens that are not plain special ones")
    vocab, alphabet = model["vocab"], _byte_alphabet()
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    specials = [t["content"] for t in spec["added_tokens"]]
    token_bytes = [b""] * (max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1)
    joined = np.zeros((256, 256), bool)
    for token, number in vocab.items():
        raw = token.encode() if token in specials else bytes(alphabet[c] for c in token)
        token_bytes[number] = raw
        for a, b in zip(raw, raw[1:], strict=False):
            joined[a, b] = True
    size = 1 << max(4, (4 * len(merges)).bit_length())
    slots, ranks, merged = np.full(size, -1, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64)
    keys = np.array([(vocab[a] << 32) + vocab[b] for a, b in merges], np.int64)
    for rank, (key, at, (a, b)) in enumerate(zip(keys.tolist(), _slot(keys, size).tolist(), merges, strict=True)):
        while slots[at] >= 0:
            at = (at + 1) % size
        slots[at], ranks[at], merged[at] = key, rank, vocab[a + b]
    by_byte = {b: vocab[c] for c, b in alphabet.items()}
    return Vocabulary(np.array([by_byte[b] for b in range(256)], np.int64), joined, slots, ranks, merged, token_bytes, specials)



def merge_all(vocabulary: Vocabulary, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words one after another, and how many each word has."""
    lengths = np.array([len(w) for w in words], np.int64)
    data = np.frombuffer(b"".join(words), np.uint8)
    word = np.repeat(np.arange(len(words)), lengths)
    # a word is cut into sequences where no token holds both bytes: no merge ever crosses
    cut = np.ones(len(data), bool)
    cut[1:] = (word[1:] != word[:-1]) | ~vocabulary.joined[data[:-1], data[1:]]
    chain, symbols, place = np.cumsum(cut) - 1, vocabulary.first[data], np.arange(len(data))
    rank, target = np.full(len(symbols), _NO_RANK), np.zeros(len(symbols), np.int64)
    inner = np.flatnonzero(chain[1:] == chain[:-1])
    rank[inner], target[inner] = vocabulary.look_up(symbols[inner], symbols[inner + 1])
    done_ids, done_places = [], []
    while len(symbols):
        begins = np.flatnonzero(np.r_[True, chain[1:] != chain[:-1]])
        lowest = np.minimum.reduceat(rank, begins)
        low = np.repeat(lowest, np.diff(np.r_[begins, len(symbols)]))
        stay = low < _NO_RANK
        if not stay.all():
            done_ids.append(symbols[~stay])
            done_places.append(place[~stay])
            symbols, chain, place, rank, target, low = (x[stay] for x in (symbols, chain, place, rank, target, low))
            if not len(symbols):
                break
        hit = np.flatnonzero(rank == low)
        # hits that follow each other are one symbol repeated: every second one merges
        near = np.flatnonzero(np.diff(hit) == 1)
        if len(near):
            fresh = np.ones(len(hit), bool)
            fresh[near + 1] = chain[hit[near]] != chain[hit[near + 1]]
            run = np.maximum.accumulate(np.where(fresh, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - run) % 2 == 0]
        symbols[hit] = target[hit]
        keep = np.ones(len(symbols), bool)
        keep[hit + 1] = False
        symbols, chain, place, rank, target = (x[keep] for x in (symbols, chain, place, rank, target))
        hit -= np.arange(len(hit))
        # only pairs with a merged symbol are looked up anew
        changed = np.zeros(len(symbols), bool)
        changed[hit] = True
        changed[hit[hit > 0] - 1] = True
        pair = np.flatnonzero(changed)
        rank[pair] = _NO_RANK
        pair = pair[pair + 1 < len(symbols)]
        pair = pair[chain[pair] == chain[pair + 1]]
        rank[pair], target[pair] = vocabulary.look_up(symbols[pair], symbols[pair + 1])
    ids = np.concatenate([np.zeros(0, np.int64), *done_ids])
    places = np.concatenate([np.zeros(0, np.int64), *done_places])
    return ids[np.argsort(places, kind="stable")], np.bincount(word[places], minlength=len(words))


class PreTokenizer:
    """Cuts text like the library's byte-level pattern; characters are classified by asking the library once each."""

    def __init__(self):
        self._kind = np.zeros(0x110000, np.uint8)
        self._library = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)

    def _learn(self, points: np.ndarray) -> None:
        for point in points.tolist():
            joined = [k for k, probe in ((_LETTER, "a"), (_NUMBER, "1"), (_OTHER, "!")) if len(self._library.pre_tokenize_str(probe + chr(point))) == 1]
            self._kind[point] = joined[0] if joined else _SPACE

    def cut(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Pre-tokens of all texts in order, and how many each text has."""
        whole = "".join(texts)
        lengths = np.array([len(t) for t in texts], np.int64)
        if not whole:
            return [], np.zeros(len(texts), np.int64)
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        kind = self._kind[points]
        if not kind.all():
            self._learn(np.unique(points[kind == 0]))
            kind = self._kind[points]
        n = len(points)
        ends = np.cumsum(lengths)
        edge = np.zeros(n + 4, bool)  # a text begins here, or all have ended
        edge[ends] = True
        edge[n:] = True
        edge[0] = True
        start = edge.copy()
        start[1:n] |= kind[1:] != kind[:-1]
        # the last space character before a word is cut from those before it; a plain space joins the word
        last = np.flatnonzero((kind[:-1] == _SPACE) & (kind[1:] != _SPACE) & ~edge[1:n])
        start[last] = True
        start[last[points[last] == 0x20] + 1] = False
        # 's 't 'm 'd 're 've 'll where a pre-token begins with the apostrophe
        quote = np.flatnonzero((points == 0x27) & start[:n])
        quote = quote[~edge[quote + 1]]
        after = np.r_[points, np.zeros(3, np.uint32)]
        one, two = after[quote + 1], np.where(edge[quote + 2], 0, after[quote + 2])
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ~short & (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
        start[quote[short | long] + 1] = False
        start[quote[short] + 2] = True
        start[quote[long] + 3] = True
        begins = np.flatnonzero(start[:n])
        stops = np.r_[begins[1:], n]
        units = [whole[a:b] for a, b in zip(begins.tolist(), stops.tolist(), strict=True)]
        return units, np.diff(np.r_[0, np.searchsorted(begins, ends)])


def pieces(text: str, size: int = SLICE_CHARS) -> Iterator[str]:
    """A text in parts of about ``size`` characters, cut before single spaces between letters.

    No token of a byte-level or a space-marked tokenizer crosses such a place. A text that has none is one part.
    """
    low = 0
    while len(text) - low > size:
        at = low + size
        while at + 1 < len(text) and not (text[at] == " " and text[at - 1].isalpha() and text[at + 1].isalpha()):
            at = text.find(" ", at + 1)
            if at < 0:
                at = len(text)
        if at + 1 >= len(text):
            break
        yield text[low:at]
        low = at
    yield text[low:]


def ragged(flat: np.ndarray, first: np.ndarray, size: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The pieces of ``flat`` at ``places``, which begin at ``first`` and have ``size`` elements, one after another."""
    count = size[places]
    shift = np.repeat(first[places] - np.cumsum(count) + count, count)
    return flat[np.arange(len(shift)) + shift]


class numbers(dict):
    """Gives each new key the next number."""

    def __missing__(self, key) -> int:
        self[key] = number = len(self)
        return number


class Memo:
    """Ids of the units seen so far, as a ragged array; ``make`` gives ids and their counts of new units."""

    def __init__(self, make: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]):
        self.make = make
        self._forget()

    def _forget(self) -> None:
        self.place = numbers()
        self.count = self.first = self.ids = np.zeros(0, np.int64)

    def places(self, units: list[str]) -> np.ndarray:
        """The place of each unit; forgets all earlier units beyond the bound."""
        if len(self.place) > MEMO_SIZE:
            self._forget()
        known = len(self.place)
        out = np.fromiter(map(self.place.__getitem__, units), np.int64, len(units))
        if len(self.place) > known:
            ids, count = self.make(list(islice(self.place, known, None)))
            self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(count) - count])
            self.count = np.concatenate([self.count, count])
            self.ids = np.concatenate([self.ids, ids])
        return out

    def gather(self, places: np.ndarray) -> np.ndarray:
        """Ids of the units at ``places``, one after another."""
        return ragged(self.ids, self.first, self.count, places)

    def sums(self, places: np.ndarray, per_text: np.ndarray) -> np.ndarray:
        """How many ids each text has, of which ``per_text`` units belong to each."""
        total = np.concatenate([[0], np.cumsum(self.count[places])])
        ends = np.cumsum(per_text)
        return total[ends] - total[ends - per_text]


class Encoder:
    """Ids of texts under one vocabulary. Special strings are ordinary text here."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.cutter = vocabulary, PreTokenizer()
        self.memo = Memo(lambda units: merge_all(vocabulary, [u.encode() for u in units]))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each text has."""
        units, per_text = self.cutter.cut(texts)
        places = self.memo.places(units)
        return self.memo.gather(places), self.memo.sums(places, per_text)

    def count(self, texts: list[str]) -> np.ndarray:
        units, per_text = self.cutter.cut(texts)
        return self.memo.sums(self.memo.places(units), per_text)
