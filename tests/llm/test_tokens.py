"""Token counts and alignments against the libraries and the plain definitions."""

import hashlib
import os
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from commentlens.llm import bytebpe, tokenalign, tokencount
from commentlens.llm.bytebpe import Encoder, load_vocabulary, pieces
from commentlens.llm.tokenalign import alignments, id_pairs
from commentlens.llm.tokencount import token_counts

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PARTS = [" ", "  ", "\n", "\t", "'", "'s", "'re", "'ll", "'ve", "'d", "'t", "a", "B", "é", "中", "٣", "1", "23", "!", "..", " ", "　", "\x1c",
         "\x85", "​", "👍", "﻿", "́", "²", "Ⅷ", "aaa", "abc", "the", " the", "\x00", "l", "<|endoftext|>", "<s>", "▁", "<0x41>", "՘"]
TEXTS = [
    "The quick brown fox isn't here, is it?", "The quick brown fox isn't here, is it?", "", None, " ", "   leading and   inner  ", "x", "Ünïcödé — “quoted” 中文字符 текст",
    "line one\nline two\r\n\tindented", "▁marked▁", "mixed ▁ mark", "<|endoftext|> a <s> </s> <unk>", "é combining", "ab" * 400, "\x00\x01", "1234567 89,000.50",
]


@pytest.fixture(scope="module")
def libraries():
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)


def noise(count, seed, longest=14):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, longest))) for _ in range(count)]


def test_ids_equal_the_library(libraries):
    library = libraries[0]
    library.encode_special_tokens = True
    texts = [*noise(4000, 1), "a" * 301, "ab" * 99, " " * 77, "x" * 50 + "y"]
    rng = random.Random(2)
    texts.append("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20_000)))
    ids, count = Encoder(load_vocabulary(BYTES)).encode(texts)
    low = 0
    for text, n in zip(texts, count, strict=True):
        assert ids[low:low + n].tolist() == library.encode(text, add_special_tokens=False).ids, text
        low += n
    library.encode_special_tokens = False


def test_memo_forgets(monkeypatch):
    encoder = Encoder(load_vocabulary(BYTES))
    want = [encoder.count([t])[0] for t in noise(300, 3)]
    monkeypatch.setattr(bytebpe, "MEMO_SIZE", 5)
    encoder = Encoder(load_vocabulary(BYTES))
    assert [encoder.count([t])[0] for t in noise(300, 3)] == want


def test_pieces_join_and_change_no_count():
    text = " ".join(["some words, and 12 more"] * 500) + "x" * 5000
    parts = list(pieces(text, 200))
    assert "".join(parts) == text and len(parts) > 20
    encoder = Encoder(load_vocabulary(BYTES))
    assert encoder.count(parts).sum() == encoder.count([text])[0]
    assert list(pieces("x" * 1000, 10)) == ["x" * 1000] and list(pieces("", 10)) == [""]


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        load_vocabulary(public_tokenizers.path("word_bpe_49k.json"))


def test_token_counts(spark, libraries, monkeypatch):
    texts = [*TEXTS, *noise(300, 4)]
    docs = spark.createDataFrame([(i % 50 if i % 7 else None, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    want = sorted((repr(i % 50 if i % 7 else None), len((t or "").encode()), n := len(libraries[0].encode(t or "", add_special_tokens=False).ids), n > 8)
                  for i, t in enumerate(texts))
    got = token_counts(docs, BYTES, limit=8)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert sorted((repr(r[0]), *r[1:]) for r in got.collect()) == want
    assert token_counts(docs.limit(0), BYTES).collect() == []


def test_counts_of_long_texts_in_parts(libraries):
    text = " ".join(noise(400, 5))
    numbers, parts = zip(*tokencount._grouped(iter([text, "a b c d e f", ""]), 30), strict=True)
    flat = [(n, p) for ns, ps in zip(numbers, parts, strict=True) for n, p in zip(ns, ps, strict=True)]
    assert "".join(p for n, p in flat if n == 0) == text and len(flat) > 10


def brute(texts, libraries):
    """Rows and pair counts by the definition, each text tokenised as a whole."""
    left, right = libraries
    left.encode_special_tokens = True
    back = {c: b for c, b in bytebpe._byte_alphabet().items()}
    names = {i: bytes(back[c] for c in t) for t, i in left.get_vocab(with_added_tokens=False).items() if t != "<|endoftext|>"}

    def spell(i):
        name = right.id_to_piece(i)
        return bytes([int(name[3:5], 16)]) if right.is_byte(i) else name.replace("▁", " ").encode()

    rows, held = [], defaultdict(int)
    for text in texts:
        a = left.encode(f" {text}", add_special_tokens=False).ids if text else []
        b = right.encode(text) if text else []
        sides = [[names[i] for i in a], [spell(i) for i in b]]
        if not text or any(b"".join(s) != f" {text}".encode() for s in sides):
            rows.append((0, 0, [], [], ""))
            continue
        ends = []
        for side in sides:
            total, out = 0, []
            for token in side:
                total += len(token)
                out.append(total)
            ends.append(out)
        shared = sorted(set(ends[0]) & set(ends[1]))
        groups, low = [], 0
        for stop in shared:
            groups.append(([i for i, e in zip(a, ends[0], strict=True) if low < e <= stop], [i for i, e in zip(b, ends[1], strict=True) if low < e <= stop]))
            low = stop
        links = Counter((x, y) for g in groups for x in g[0] for y in g[1])
        for pair in links:
            held[pair] += 1
        listed = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        rows.append((len(a), len(b), groups, links, hashlib.sha256(listed.encode()).hexdigest()))
    most = defaultdict(int)
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    left.encode_special_tokens = False
    return [(a, b, len(g), sum(dict(k).values()), sum(n for p, n in dict(k).items() if held[p] == most[p[0]]), sum(n * held[p] for p, n in dict(k).items()), s)
            for a, b, g, k, s in rows], held, most


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("parts", [1, 5])
def test_alignments(spark, libraries, parts):
    texts = [*TEXTS, *noise(150, 6), *(t.replace("▁", "") for t in noise(150, 7, 40))]
    docs = spark.createDataFrame([(i % 90 if i % 11 else None, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, block int").repartition(parts)
    rows, held, most = brute(texts, libraries)
    got = alignments(docs, BYTES, PIECES)
    assert got.columns == COLUMNS
    want = sorted((repr(i % 90 if i % 11 else None), *r) for i, r in enumerate(rows))
    assert sorted((repr(r[0]), *r[1:]) for r in got.collect()) == want
    assert sum(r[1] > 0 for r in want) > 200
    pairs = {(r.a, r.b): (r.docs, r.top) for r in id_pairs(docs, BYTES, PIECES).collect()}
    assert pairs == {p: (n, n == most[p[0]]) for p, n in held.items()}
    assert alignments(docs.limit(0), BYTES, PIECES).collect() == []


def test_blocks_and_parts_change_nothing(libraries, monkeypatch):
    """Small blocks, a memo that is forgotten, and long texts in parts, without Spark around them."""
    import pyarrow as pa

    texts = [*TEXTS, *noise(60, 8), " ".join(f"word{i} and some text" for i in range(300)), "long with mark " * 30 + "▁"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], names=["doc_id", "text"])

    class Shared:
        def __init__(self, value):
            self.value = value

    class Task:
        @staticmethod
        def get():
            return Task

        @staticmethod
        def partitionId():  # noqa: N802
            return 3

    monkeypatch.setattr(tokenalign, "TaskContext", Task)
    monkeypatch.setattr(tokenalign, "SLICE_CHARS", 150)
    monkeypatch.setattr(tokenalign, "BLOCK_WINDOWS", 80)
    monkeypatch.setattr(tokenalign, "BLOCK_KINDS", 60)
    with open(PIECES, "rb") as file:
        run = tokenalign._finder(Shared(load_vocabulary(BYTES)), Shared(file.read()))
    found = pa.Table.from_batches(list(run(iter([batch]))))
    rows, held, most = brute(texts, libraries)
    blocks = sorted(set(found["block"].to_pylist()))
    assert len(blocks) > 2
    totals = defaultdict(int)
    for row in found.to_pylist():
        for a, b, n in zip(row["a"] or [], row["b"] or [], row["docs"] or [], strict=True):
            totals[a, b] += n
    assert totals == held
    out = []
    for block in blocks:
        part = found.filter(pa.compute.equal(found["block"], block))
        listed = [(a, b) for r in part.to_pylist() for a, b in zip(r["a"] or [], r["b"] or [], strict=True)]
        pairs = pa.table({"place": pa.array(range(len(listed)), pa.int32()), "docs": [held[p] for p in listed], "top": [held[p] == most[p[0]] for p in listed]})
        out += [tuple(r.values()) for r in tokenalign._told(part, pairs).to_pylist()]
    assert sorted(out) == [(i, *r) for i, r in enumerate(rows)]


def test_packing():
    import numpy as np

    values = np.array([0, 1, 127, 128, 16383, 16384, 2097151, 2097152, 268435456, (1 << 35) - 1, 5])
    assert tokenalign.unpack(tokenalign.pack(values)[0].tobytes()).tolist() == values.tolist()
    assert tokenalign.unpack(b"").tolist() == []
