"""Alignment of two tokenizers over a corpus by whitespace-token anchors.

Whole texts are tokenised under both vocabularies, each different unit between spaces once per task, as
no token crosses from one to the next. Where tokens of both end at the same byte, both sides spell the
same bytes and both next tokens begin with a space, an anchor splits the document into windows, pairs of
id tuples. A window is aligned once per task and remembered by its ids: its groups end where tokens of
both sides end, and all pairs of a group are links. Documents keep only the numbers of their windows.

Documents are dealt into blocks inside the task that reads them. A block lists its different id pairs
with the number of its documents that hold them; Spark adds these up over the corpus and sends each
block the totals of its own pairs. So neither documents nor links are joined by id pair, and a pair
that all documents hold is one row per block.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commentlens.llm.bytebpe import SLICE_CHARS, Encoder, Vocabulary, load_vocabulary, numbers, pieces, ragged
from commentlens.session import written_table

#: Window occurrences and different windows from which a block is closed.
BLOCK_WINDOWS, BLOCK_KINDS = 4_000_000, 400_000
_SPACES = re.compile(r"\s |\s\Z|\A ")


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of non-negative integers, seven bits each with the lowest first, and how many bytes each has."""
    size = 1 + sum((values >> (7 * k) > 0).astype(np.int64) for k in range(1, 6))
    out = np.zeros(int(size.sum()), np.uint8)
    first = np.cumsum(size) - size
    for k in range(6):
        has = size > k
        out[first[has] + k] = (values[has] >> (7 * k)) & 127 | np.where(size[has] > k + 1, 128, 0)
    return out, size


def unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64)
    first = np.concatenate([[0], np.flatnonzero(raw < 128)[:-1] + 1])
    place = np.arange(len(raw)) - np.repeat(first, np.diff(np.concatenate([first, [len(raw)]])))
    return np.add.reduceat((raw & 127).astype(np.int64) << (7 * place), first)


class Tokens:
    """Bytes of all tokens of a vocabulary."""

    def __init__(self, token_bytes: list[bytes]):
        self.size = np.array([len(t) for t in token_bytes], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(token_bytes), np.uint8)
        self.spaced = np.array([t[:1] == b" " for t in token_bytes])

    def spell(self, ids: np.ndarray) -> np.ndarray:
        return ragged(self.flat, self.first, self.size, ids)


class PieceEncoder:
    """Ids of texts under a sentence piece model. The model itself puts a space before what it encodes."""

    def __init__(self, model: bytes):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        names = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        self.tokens = Tokens([bytes([int(n[3:5], 16)]) if self.model.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)])
        #: No piece goes on after a space that follows something else, so that words can be encoded one by one.
        self.by_word = all("▁" not in n.lstrip("▁") for n in names)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each of which begins with a space, and how many each text has."""
        found = self.model.encode([t[1:] for t in texts], num_threads=1)
        return np.array([i for ids in found for i in ids], np.int64), np.array([len(ids) for ids in found], np.int64)


class Windows:
    """Both encoders, the aligned windows of a task, and the windows of the units that it has tokenised."""

    def __init__(self, vocabulary: Vocabulary, model: bytes):
        self.left, self.right = Encoder(vocabulary), PieceEncoder(model)
        self.a, self.b = Tokens(vocabulary.token_bytes), self.right.tokens
        # a token's number with what follows it in a list of groups
        texts = [[f"{i}{end}".encode() for i in range(len(t.size))] for t, ends in ((self.a, ",|"), (self.b, ",;")) for end in ends]
        self.base = np.cumsum([0, *map(len, texts)])
        self.said = Tokens([x for part in texts for x in part])
        self.forget()

    def forget(self) -> None:
        self.place, self.pairs, self.units = numbers(), numbers(), numbers()
        self.groups = self.links = self.link_first = self.texts_first = self.texts_size = self.link_size = np.zeros(0, np.int64)
        self.unit_first = self.unit_size = self.unit_windows = self.unit_a = self.unit_b = np.zeros(0, np.int64)
        self.texts, self.unit_good = np.zeros(0, np.uint8), np.zeros(0, bool)

    def split(self, text: str) -> list[str]:
        """Parts between spaces that follow no other white space; a space belongs before each part. No token crosses there."""
        if not self.right.by_word:
            return [text]
        words = text.split(" ")
        if not _SPACES.search(text):
            return words
        out = words[:1]
        for word in words[1:]:
            if not out[-1] or out[-1][-1].isspace():
                out[-1] += f" {word}"
            else:
                out.append(word)
        if not out[-1] and len(out) > 1:
            out[-2:] = [f"{out[-2]} "]
        return out

    def find(self, texts: list[str]) -> tuple[np.ndarray, ...]:
        """Windows of all texts in order (a space belongs before each), how many each has, which are spelt, tokens of both sides."""
        units, per_text = [], np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            found = self.split(text)
            units += found
            per_text[k] = len(found)
        known = len(self.units)
        place = np.fromiter(map(self.units.__getitem__, units), np.int64, len(units))
        if len(self.units) > known:
            self._tokenise([f" {u}" for u in islice(self.units, known, None)])
        good = _sums(~self.unit_good[place], per_text) == 0
        kept = place[np.repeat(good, per_text)]
        count, n_a, n_b = (_sums(np.where(np.repeat(good, per_text), x[place], 0), per_text) for x in (self.unit_size, self.unit_a, self.unit_b))
        return ragged(self.unit_windows, self.unit_first, self.unit_size, kept), count, good, n_a, n_b

    def _tokenise(self, units: list[str]) -> None:
        good, sides = self.exact(units)
        windows, size = self.of(sides, good)
        self.unit_first = np.concatenate([self.unit_first, len(self.unit_windows) + np.cumsum(size) - size])
        self.unit_size = np.concatenate([self.unit_size, size])
        self.unit_windows = np.concatenate([self.unit_windows, windows])
        self.unit_good = np.concatenate([self.unit_good, good])
        self.unit_a, self.unit_b = (np.concatenate([x, count]) for x, (_, count) in zip((self.unit_a, self.unit_b), sides, strict=True))

    def exact(self, texts: list[str]) -> tuple[np.ndarray, list]:
        """Which texts both sides spell byte by byte, and the ids and counts of both sides."""
        raw = [t.encode() for t in texts]
        data, size = np.frombuffer(b"".join(raw), np.uint8), np.array([len(t) for t in raw], np.int64)
        first = np.cumsum(size) - size
        good, sides = np.ones(len(texts), bool), []
        for encoder, tokens in ((self.left, self.a), (self.right, self.b)):
            ids, count = encoder.encode(texts)
            spelt, spelt_size = tokens.spell(ids), _sums(tokens.size[ids], count)
            if not np.array_equal(spelt, data):
                spelt_first = np.cumsum(spelt_size) - spelt_size
                good &= [s == n and np.array_equal(spelt[x:x + s], data[y:y + n]) for s, n, x, y in zip(spelt_size, size, spelt_first, first, strict=True)]
            sides.append((ids, count))
        return good, sides

    def of(self, sides: list, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the windows of the good texts in order, and how many each text has."""
        (a_ids, a_count), (b_ids, b_count) = ((ids[np.repeat(good, count)], np.where(good, count, 0)) for ids, count in sides)
        if not len(a_ids):
            return np.zeros(0, np.int64), np.zeros(len(good), np.int64)
        a_start, b_start = (np.cumsum(t.size[ids]) - t.size[ids] for t, ids in ((self.a, a_ids), (self.b, b_ids)))
        # both tokens before an anchor end there, as these starts are ends
        a_spaced, b_spaced = a_start[self.a.spaced[a_ids]], b_start[self.b.spaced[b_ids]]
        at = np.minimum(np.searchsorted(b_spaced, a_spaced), max(len(b_spaced) - 1, 0))
        shared = a_spaced[b_spaced[at] == a_spaced] if len(b_spaced) else a_spaced[:0]
        begins = a_start[(np.cumsum(a_count) - a_count)[a_count > 0]]
        anchors = np.unique(np.concatenate([shared, begins]))
        a_low, b_low = np.searchsorted(a_start, anchors), np.searchsorted(b_start, anchors)
        a_raw, b_raw = a_ids.astype("<u4").tobytes(), b_ids.astype("<u4").tobytes()
        a_cut, b_cut = [*(4 * a_low).tolist(), len(a_raw)], [*(4 * b_low).tolist(), len(b_raw)]
        keys = [(a_raw[w:x], b_raw[y:z]) for w, x, y, z in zip(a_cut, a_cut[1:], b_cut, b_cut[1:], strict=False)]
        known = len(self.place)
        found = np.fromiter(map(self.place.__getitem__, keys), np.int64, len(keys))
        if len(self.place) > known:
            self._align(list(islice(self.place, known, None)))
        stops = np.searchsorted(a_low, np.cumsum(a_count))
        return found, np.diff(np.concatenate([[0], stops]))

    def _align(self, keys: list[tuple[bytes, bytes]]) -> None:
        """Groups, links and their text of each new window."""
        a_ids, b_ids = (np.frombuffer(b"".join(k[side] for k in keys), "<u4").astype(np.int64) for side in (0, 1))
        a_count = np.array([len(k[0]) // 4 for k in keys], np.int64)
        a_end, b_end = np.cumsum(self.a.size[a_ids]), np.cumsum(self.b.size[b_ids])
        a_last = b_end[np.minimum(np.searchsorted(b_end, a_end), len(b_end) - 1)] == a_end
        b_last = a_end[np.minimum(np.searchsorted(a_end, b_end), len(a_end) - 1)] == b_end
        a_group, b_group = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
        a_in, b_in = np.bincount(a_group), np.bincount(b_group)
        stops = np.cumsum(a_count)
        groups = np.diff(np.concatenate([[0], np.cumsum(a_last)[stops - 1]]))
        group_stop = np.cumsum(groups)

        def by_window(per_group: np.ndarray) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(per_group)])
            return total[group_stop] - total[group_stop - groups]

        # every token of the left side meets all tokens of its group on the right side
        meets = b_in[a_group]
        b_first = np.cumsum(b_in) - b_in
        step = np.arange(int(meets.sum())) - np.repeat(np.cumsum(meets) - meets, meets)
        link = (np.repeat(a_ids, meets) << 32) + b_ids[np.repeat(b_first[a_group], meets) + step]
        link = np.fromiter(map(self.pairs.__getitem__, link.tolist()), np.int64, len(link))
        # the text of a group: its left ids, then its right ids
        code = np.concatenate([a_ids + self.base[a_last.astype(int)], b_ids + self.base[2 + b_last.astype(int)]])
        code = code[np.argsort(np.concatenate([2 * a_group, 2 * b_group + 1]), kind="stable")]
        sizes = by_window(np.bincount(np.concatenate([a_group, b_group]), self.said.size[np.concatenate(
            [a_ids + self.base[a_last.astype(int)], b_ids + self.base[2 + b_last.astype(int)]])]).astype(np.int64))
        counts = by_window(a_in * b_in)
        self.link_first = np.concatenate([self.link_first, len(self.links) + np.cumsum(counts) - counts])
        self.link_size = np.concatenate([self.link_size, counts])
        self.links = np.concatenate([self.links, link])
        self.texts_first = np.concatenate([self.texts_first, len(self.texts) + np.cumsum(sizes) - sizes])
        self.texts_size = np.concatenate([self.texts_size, sizes])
        self.texts = np.concatenate([self.texts, self.said.spell(code)])
        self.groups = np.concatenate([self.groups, groups])


_FOUND = ("block long, is_doc boolean, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, windows binary, "
          "kinds binary, sizes binary, links binary, a array<int>, b array<int>, docs array<int>")
_FOUND_SCHEMA = pa.schema([
    ("block", pa.int64()), ("is_doc", pa.bool_()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
    ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("windows", pa.binary()), ("kinds", pa.binary()), ("sizes", pa.binary()),
    ("links", pa.binary()), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32())), ("docs", pa.list_(pa.int32())),
])
_OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _sums(values: np.ndarray, count: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(count)
    return total[ends] - total[ends - count]


class _Block:
    """What a task has found since it last closed a block."""

    def __init__(self, windows: Windows):
        self.windows, self.seen = windows, 0
        self.used, self.docs = np.zeros(0, bool), np.zeros(0, np.int64)

    def add(self, found: np.ndarray, count: np.ndarray) -> list[bytes]:
        """Counts the pairs of documents with ``count`` windows each; their packed windows."""
        w, n = self.windows, len(self.windows.groups)
        self.seen += len(found)
        self.used = np.concatenate([self.used, np.zeros(n - len(self.used), bool)])
        self.docs = np.concatenate([self.docs, np.zeros(len(w.pairs) - len(self.docs), np.int64)])
        self.used[found] = True
        key = np.sort(np.repeat(np.arange(len(count)), count) * n + found)
        once = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
        doc, kind = once // max(n, 1), once % max(n, 1)
        held = np.sort(np.repeat(doc, w.link_size[kind]) * len(w.pairs) + ragged(w.links, w.link_first, w.link_size, kind))
        held = held[np.concatenate([[True], held[1:] != held[:-1]])] if len(held) else held
        self.docs += np.bincount(held % max(len(w.pairs), 1), minlength=len(self.docs))
        step = key % max(n, 1)
        inner = np.ones(len(step), bool)
        inner[(np.cumsum(count) - count)[count > 0]] = False
        step[inner] = np.diff(step, prepend=0)[inner]
        raw, size = pack(step)
        ends = np.cumsum(_sums(size, count))
        data = raw.tobytes()
        return [data[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def listing(self) -> dict:
        """The block's windows and id pairs as the fields of one row."""
        w = self.windows
        kinds, pairs = np.flatnonzero(self.used), np.flatnonzero(self.docs)
        place = np.cumsum(self.docs > 0) - 1
        keys = np.fromiter(w.pairs, np.int64, len(w.pairs))[pairs]
        links = place[ragged(w.links, w.link_first, w.link_size, kinds)] if len(kinds) else kinds
        packed = [pack(x)[0].tobytes() for x in (np.diff(kinds, prepend=0), w.link_size[kinds], links)]
        return dict(zip(("kinds", "sizes", "links"), packed, strict=True)) | {"a": keys >> 32, "b": keys & 0xFFFFFFFF, "docs": self.docs[pairs]}


def _finder(vocabulary, model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(vocabulary.value, model.value)
        block, number = _Block(windows), TaskContext.get().partitionId() << 32

        def rows(**columns) -> pa.RecordBatch:
            n = len(next(iter(columns.values())))
            return pa.RecordBatch.from_arrays(
                [pa.array([number] * n if f.name == "block" else columns.get(f.name, [None] * n), f.type) for f in _FOUND_SCHEMA], schema=_FOUND_SCHEMA)

        def closed() -> pa.RecordBatch:
            return rows(is_doc=[False], **{k: [v] for k, v in block.listing().items()})

        for batch in batches:
            for ids, texts in _grouped(batch):
                long = len(texts) == 1 and len(texts[0]) > SLICE_CHARS
                n_a, n_b, n_groups, n_links, shas, packed = _long(windows, block, texts[0]) if long else _short(windows, block, texts)
                yield rows(is_doc=[True] * len(ids), doc_id=ids, n_a=n_a, n_b=n_b, n_groups=n_groups, n_links=n_links, groups_sha256=shas, windows=packed)
                if block.seen >= BLOCK_WINDOWS or len(windows.place) >= BLOCK_KINDS:
                    yield closed()
                    number += 1
                    if len(windows.place) >= BLOCK_KINDS:
                        windows.forget()
                    block = _Block(windows)
        if block.seen:
            yield closed()

    return run


def _grouped(batch: pa.RecordBatch) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of about a slice together; a longer text comes alone."""
    ids, texts, held = [], [], 0
    for row in range(len(batch)):
        text = batch.column(1)[row].as_py() or ""
        if texts and held + len(text) > SLICE_CHARS:
            yield ids, texts
            ids, texts, held = [], [], 0
        ids.append(batch.column(0)[row].as_py())
        texts.append(text)
        held += len(text)
    if texts:
        yield ids, texts


def _short(windows: Windows, block: _Block, texts: list[str]):
    found, count, good, n_a, n_b = windows.find(texts)
    good &= np.array([bool(t) for t in texts])
    found = found[np.repeat(good, count)] if not good.all() else found
    count, n_a, n_b = (np.where(good, x, 0) for x in (count, n_a, n_b))
    said = ragged(windows.texts, windows.texts_first, windows.texts_size, found).tobytes()
    ends = np.cumsum(_sums(windows.texts_size[found], count)).tolist()
    # the separator after the last group is left out
    shas = [hashlib.sha256(said[a:b - 1]).hexdigest() if b > a else "" for a, b in zip([0, *ends], ends, strict=False)]
    return n_a, n_b, _sums(windows.groups[found], count), _sums(windows.link_size[found], count), shas, block.add(found, count)


def _long(windows: Windows, block: _Block, text: str):
    every, n_a, n_b, sha = [], 0, 0, hashlib.sha256()
    for part in pieces(f" {text}", SLICE_CHARS):
        found, _, good, a, b = windows.find([part[1:]])
        if not good[0]:
            return [0], [0], [0], [0], [""], [b""]
        sha.update(b";" * bool(every) + ragged(windows.texts, windows.texts_first, windows.texts_size, found).tobytes()[:-1])
        every.append(found)
        n_a, n_b = n_a + int(a[0]), n_b + int(b[0])
    found = np.concatenate(every)
    count = np.array([len(found)])
    return [n_a], [n_b], _sums(windows.groups[found], count), _sums(windows.link_size[found], count), [sha.hexdigest()], block.add(found, count)


def _told(found: pa.Table, pairs: pa.Table) -> pa.Table:
    """The documents of one block with the sums over their links."""
    is_doc = found["is_doc"].combine_chunks()
    docs, listing = found.filter(is_doc), found.filter(pc.invert(is_doc))
    n = len(docs)
    best, total = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if len(listing):
        order = np.argsort(pairs["place"].to_numpy())
        count, top = pairs["docs"].to_numpy()[order], pairs["top"].to_numpy().astype(np.int64)[order]
        kinds, sizes, links = (unpack(listing[c][0].as_py()) for c in ("kinds", "sizes", "links"))
        kinds = np.cumsum(kinds)
        kind_best, kind_total = _sums(top[links], sizes), _sums(count[links], sizes)
        for row, packed in enumerate(docs["windows"]):
            place = np.searchsorted(kinds, np.cumsum(unpack(packed.as_py())))
            best[row], total[row] = kind_best[place].sum(), kind_total[place].sum()
    columns = [docs[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
    return pa.table([*columns, pa.array(best), pa.array(total), docs["groups_sha256"]], names=[c.split()[0] for c in _OUT.split(", ")])


def _found(docs: DataFrame, left: str, right: str, id_col: str, text_col: str) -> DataFrame:
    context = docs.sparkSession.sparkContext
    with open(right, "rb") as file:
        model = context.broadcast(file.read())
    plain = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return written_table(plain.mapInArrow(_finder(context.broadcast(load_vocabulary(left)), model), _FOUND), "align-found")


def _pair_counts(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Id pairs of each block with their place, and of the corpus with their documents and whether no pair of the left id has more."""
    pairs = found.where("NOT is_doc").select("block", F.posexplode(F.arrays_zip("a", "b", "docs")).alias("place", "p")).select("block", "place", "p.*")
    counts = written_table(pairs.groupBy("a", "b").agg(F.sum("docs").cast("long").alias("docs")), "align-pairs")
    # one row per id of the left vocabulary at most, whatever the corpus
    most = counts.groupBy("a").agg(F.max("docs").alias("most"))
    return pairs.drop("docs"), counts.join(F.broadcast(most), "a").select("a", "b", "docs", (F.col("docs") == F.col("most")).alias("top"))


def id_pairs(docs: DataFrame, left: str, right: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The linked id pairs of the corpus: ``a``, ``b``, ``docs`` (rows that hold the pair linked), ``top`` (highest of its ``a``)."""
    return _pair_counts(_found(docs, left, right, id_col, text_col))[1]


def alignments(docs: DataFrame, left: str, right: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, ``groups_sha256``.

    ``left`` is a byte-level BPE ``tokenizer.json`` for a space and the text, ``right`` a sentence piece model for the
    text, both read by the driver. A text that is null, empty, or not spelt byte by byte by both has no tokens: zeros and
    an empty digest. ``n_best`` counts links whose pair is held by as many rows as any pair of its left id; ``count_sum``
    adds the rows that hold each link's pair. Each row is a document, so equal rows count one by one and ids may be null
    or repeat. A text beyond a million characters is handled in parts cut between letters; neither tokens nor windows
    cross there. An empty table gives an empty result; other columns are ignored.
    """
    found = _found(docs, left, right, id_col, text_col)
    pairs, counts = _pair_counts(found)
    told = pairs.join(counts, ["a", "b"]).select(F.col("block").alias("home"), "place", "docs", "top")
    kept = found.select("block", "is_doc", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "windows", "kinds", "sizes", "links")
    out = kept.groupBy("block").cogroup(told.groupBy("home")).applyInArrow(_told, _OUT)
    return out.withColumnRenamed("doc_id", id_col)
