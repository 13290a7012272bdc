"""Exact, near, passage and line de-duplication against brute force, and their edge cases."""

import hashlib
import random
import re

import numpy as np
import pytest

from commentlens.llm.blocknames import exact_duplicates
from commentlens.llm.circulant import near_duplicates, signatures
from commentlens.llm.linetemplates import drop_recurring_lines
from commentlens.llm.superkmers import drop_repeats

SCHEMA = "doc_id long, text string, name string, row string, level string, key string"
EDGES = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one two three"), (4, "one two three"), (None, "one two three"), (None, "only without id here now"),
    (5, "Ünïcode wörds \x00 zero"), (6, "a b c d e f g h"), (7, "a  b\tc d e\nf g h"), (8, "word " * 30_000),
]


def frame(spark, rows):
    """Extra columns have names that the operators use inside."""
    return spark.createDataFrame([(i, t, "n", "r", "l", "k") for i, t in rows], SCHEMA)


def prose(rng, n, size=40):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


def collapsed(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


@pytest.mark.parametrize("hash_bits,block_bytes", [(64, 1024), (2, 4), (64, 3)])
def test_exact_against_brute_force(spark, hash_bits, block_bytes):
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.randrange(6), 3)) for i in range(60)] + EDGES
    got = exact_duplicates(frame(spark, rows), hash_bits=hash_bits, block_bytes=block_bytes, ranges=8).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(collapsed(t), []).append(i)
    want = []
    for i, t in rows:
        ids = [x for x in groups[collapsed(t)] if x is not None]
        want.append((i, min(ids) if ids else None, len(groups[collapsed(t)]), hashlib.sha256(collapsed(t).encode()).hexdigest()))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r[0], r[1], r[2], r[4]) for r in got), key=key) == sorted(want, key=key)
    assert sum(r.kept for r in got) == len(groups)


@pytest.mark.parametrize("operator", [exact_duplicates, near_duplicates, drop_repeats, drop_recurring_lines])
def test_empty_table(spark, operator):
    assert operator(frame(spark, [])).collect() == []


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def linked_components(rows, size, percent=80):
    sets = [shingles(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    best = {}
    for i, (doc, _) in enumerate(rows):
        best[find(i)] = min(best.get(find(i), doc), doc)
    return {doc: (len(sets[i]), best[find(i)]) for i, (doc, _) in enumerate(rows)}


def edited(rng, text, changes):
    words = text.split(" ")
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    return " ".join(words)


def test_near_against_brute_force(spark):
    rng = random.Random(5)
    bases = [prose(rng, 150, 10**6) for _ in range(4)]
    rows = [(i, edited(rng, rng.choice(bases), rng.randrange(9))) for i in range(250)]
    rows += [(300, None), (301, ""), (302, " "), (303, "Just Two"), (304, "just\ttwo"), (305, rows[0][1].upper().lower()), (306, "solo")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(frame(spark, rows), shingle=4).collect()}
    assert got == linked_components(rows, 4)


def test_near_edges(spark):
    got = near_duplicates(frame(spark, EDGES)).collect()
    assert len(got) == len(EDGES)
    assert all(r.kept and r.component_id is None for r in got if r.doc_id is None)
    assert all(r.component_id == r.doc_id for r in got if r.doc_id in (1, 2, 3))
    assert {r.component_id for r in got if r.doc_id in (6, 7)} == {6}


def test_near_copies_of_repeated_ids(spark):
    rng = random.Random(8)
    a, b, c = (prose(rng, 120, 10**6) for _ in range(3))
    rows = [(1, a), (1, b), (2, edited(rng, a, 2)), (3, edited(rng, b, 2)), (1, a), (7, c), (6, b), (0, edited(rng, b, 2)), (7, None), (8, edited(rng, c, 2)), (9, a)]
    got = sorted((r.doc_id, r.n_shingles > 0, r.component_id, r.kept) for r in near_duplicates(frame(spark, rows)).collect())
    assert got == sorted([
        (1, True, 1, True), (1, True, 1, True), (1, True, 0, False), (2, True, 1, False), (3, True, 0, False), (6, True, 0, False), (0, True, 0, True),
        (7, True, 7, True), (7, False, 7, True), (8, True, 7, False), (9, True, 1, False)])


def test_circulant_estimates_similarity():
    rng = np.random.default_rng(1)
    shared = rng.integers(0, 1 << 63, 800).astype(np.uint64)
    a = np.concatenate([shared, rng.integers(0, 1 << 63, 100).astype(np.uint64)])
    b = np.concatenate([shared, rng.integers(0, 1 << 63, 100).astype(np.uint64)])
    rows = signatures([np.unique(a), np.unique(b)], 1024)
    assert abs((rows[0] == rows[1]).mean() - 0.8) < 0.05


def removed(rows, words):
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    least = {}
    for i, w in split:
        for k in range(len(w) - words + 1):
            key = tuple(w[k:k + words])
            least[key] = min(least.get(key, 1 << 63), (1 << 62) if i is None else i)
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - words + 1):
            if least[tuple(w[k:k + words])] < ((1 << 62) if i is None else i):
                gone.update(range(k, k + words))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot_docs", [3, 10**6])
def test_passages_against_brute_force(spark, hot_docs):
    rng = random.Random(9)
    passages = [prose(rng, 30, 10**6) for _ in range(3)]
    rows = [(i, " ".join([prose(rng, rng.randrange(30)), rng.choice(passages), prose(rng, rng.randrange(30), 3)])) for i in range(80)]
    rows += [(90, "again " * 100), (91, "again " * 40), (92, None), (None, passages[0]), (None, passages[0] + " tail"), (93, "short")]
    rows += [rows[0], (0, passages[1])]
    got = drop_repeats(frame(spark, rows), words=12, gram=4, hot_docs=hot_docs).collect()
    assert sorted((tuple(r) for r in got), key=str) == removed(rows, 12)


def test_passages_edges_and_text(spark):
    got = {(r.doc_id, r.n_words): r for r in drop_repeats(frame(spark, EDGES), words=8, gram=4, with_text=True).collect()}
    assert got[(7, 8)].n_removed == 8 and got[(7, 8)].kept_text == ""
    assert got[(6, 8)].n_removed == 0 and got[(8, 30_000)].n_removed == 0
    assert got[(1, 0)].kept_sha256 == hashlib.sha256(b"").hexdigest()


def test_line_templates(spark):
    rows = [(i, f"Request {i} took {i * 7} ms on node n{i}\nunique {'abcdefgh'[i]} text only {'hgfedcba'[i]} here\n\n  All   rights reserved. ")
            for i in range(6)]
    rows += [(10, "Connect to host alpha now please\nlast"), (11, "Connect to host beta now please"), (12, "Connect to host gamma now please"),
             (13, None), (14, ""), (None, "All rights reserved."), (15, "All rights reserved.\nAll rights reserved.")]
    got = {r.doc_id: r for r in drop_recurring_lines(frame(spark, rows), with_text=True).collect()}
    assert got[0].n_dropped == 0 and got[0].n_lines == 4
    for i in range(1, 6):
        assert got[i].kept_text.split("\n")[0].startswith("unique") and got[i].n_dropped == 2
    assert got[10].n_dropped == 0 and got[11].n_dropped == 1 and got[12].n_dropped == 1
    assert got[13].n_lines == 1 and got[14].n_dropped == 0
    assert got[None].n_dropped == 1 and got[15].n_dropped == 2
    assert got[15].kept_sha256 == hashlib.sha256(b"").hexdigest()


def test_lines_of_two_documents(spark):
    shared = "one line that exactly two documents have"
    rows = [(1, f"{shared}\nonly here 1"), (2, f"alone\n  {shared} \n{shared}"), (3, "another line of one document only"),
            (4, "Connect to host alpha now please"), (5, "Connect to host beta now please"), (6, "seen twice but\nseen twice but"), (7, "took 5 ms"), (8, "took 77 ms")]
    got = {r.doc_id: r for r in drop_recurring_lines(frame(spark, rows), with_text=True).collect()}
    assert got[2].n_dropped == 2 and got[2].kept_text == "alone"
    assert got[8].n_dropped == 1
    # two documents make no generalised template, and a repeat in one document is none across documents
    assert {i for i in got if got[i].n_dropped} == {2, 8}


def recurring(rows, min_docs=3, lead=3, alike=70):
    """The definition: rows of id, lines, dropped lines and digest of the kept text."""
    no_id = (1 << 63) - 1
    lines = {}
    for i, text in rows:
        i = no_id if i is None else i
        for pos, line in enumerate((text or "").split("\n")):
            tokens = [("<*>" if re.search("[0-9]", t) else t) for t in re.sub(r"[\x20\x09-\x0D]+", " ", line).strip(" ").split(" ")]
            if tokens != [""]:
                lines.setdefault((i, text or "", pos), tokens)
    # rows that repeat id and text count each time in a leaf, but are one document
    copies = {}
    for i, text in rows:
        copies[no_id if i is None else i, text or ""] = copies.get((no_id if i is None else i, text or ""), 0) + 1
    leaves, equal = {}, {}
    for key, tokens in lines.items():
        leaves.setdefault((len(tokens), *tokens[:lead]), []).append((key, tokens))
        equal.setdefault(tuple(tokens), []).append(key)
    gone = set()
    for keys in equal.values():
        gone |= {k for k in keys if k[0] > min(keys)[0]}
    for members in leaves.values():
        n = sum(copies[k[:2]] for k, _ in members)
        if len({tuple(t) for _, t in members}) < 2 or n < min_docs or len({k[0] for k, _ in members}) < 2:
            continue
        template = []
        for at in range(len(members[0][1])):
            counts = {}
            for k, t in members:
                counts[t[at]] = counts.get(t[at], 0) + copies[k[:2]]
            most, token = max((c, t.encode()) for t, c in counts.items())
            template.append(token.decode() if 2 * most >= n and token != b"<*>" else "<*>")
        if len(template) > lead and all(t == "<*>" for t in template[lead:]):
            continue
        fit = [k for k, t in members if 100 * sum(a in (b, "<*>") for a, b in zip(t, template, strict=True)) >= alike * len(t)]
        if len({k[0] for k in fit}) >= min_docs:
            gone |= {k for k in fit if k[0] > min(fit)[0]}
    out = []
    for i, text in rows:
        parts = (text or "").split("\n")
        kept = [x for pos, x in enumerate(parts) if (no_id if i is None else i, text or "", pos) not in gone]
        out.append((i, len(parts), len(parts) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_lines_against_brute_force(spark, seed):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "x1", "n27", "Ünï", "a\x0bb", "7", "-"]
    starts = ["Request done by", "Connect to host", "All rights reserved", "note"]

    def line():
        rest = [rng.choice(words) for _ in range(rng.randrange(5))]
        return rng.choice([" ", "\t", "  "]).join([*rng.choice(starts).split(), *rest]) + rng.choice(["", " ", "\r"])

    rows = [(rng.choice([k, k, k, None, 3]), "\n".join(line() if rng.random() < 0.8 else "" for _ in range(rng.randrange(6)))) for k in range(70)]
    rows += [*rows[:6], (200, None), (201, "word " * 20_000 + "\n" + "All rights reserved alpha"), (202, "word " * 20_000)]
    got = sorted((tuple(r) for r in drop_recurring_lines(frame(spark, rows)).collect()), key=str)
    assert got == recurring(rows) and sum(r[2] for r in got) > 20
