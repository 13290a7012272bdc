"""Secret scanning: fixed patterns, and formats inferred from the credentials that they find.

The values that the patterns label (a password, an access key, a hexadecimal key) are strings of
character classes. They are put into a prefix tree; states whose continuations are statistically
compatible (Hoeffding's bound) are merged, which turns the tree into a probabilistic automaton. Every
long token outside the labelled spans is then scored: its log likelihood under the automaton of the
best kind against that of ordinary tokens, per character. Tokens above a threshold are added as
``format`` spans. The patterns' spans always stay.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commentlens.session import written_table

#: Fixed values of the contract: kind, pattern, least length and the group that it counts for.
PATTERNS = (
    ("assign", re.compile(r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
                          r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), 12, 2),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 18, 0),
    ("hex", re.compile(r"[0-9a-f]+"), 16, 0),
)
KINDS = ("assign", "access", "hex", "format")
#: A token that may be a credential.
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: Labelled credentials of each kind that the automata learn from at most, and the characters that one of
#: these may have. Ordinary tokens are counted all, and every token is scored, whatever its length.
FIT_VALUES, FIT_LENGTH = 800, 256
#: Confidence of a merge, and the advantage per character from which a token counts as a credential.
ALPHA, ADVANTAGE = 0.05, 1.6

#: Class of a character and how many characters it has.
_CLASSES = {"d": 10, "h": 6, "l": 20, "U": 26, "s": 6}


def symbols(value: str) -> str:
    """Character classes: digits, a-f, other small letters, capitals, signs."""
    return "".join("d" if c.isdigit() else "h" if "a" <= c <= "f" else "l" if "a" <= c <= "z" else "U" if "A" <= c <= "Z" else "s" for c in value)


class Automaton:
    """A probabilistic automaton by merging compatible states of a prefix tree, the nearest to the root first."""

    def __init__(self, values: list[str], alpha: float = ALPHA):
        self.ends: list[int] = [0]
        self.steps: list[dict[str, list[int]]] = [{}]  # symbol -> [target, count]
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        for value in values:
            state = 0
            for c in symbols(value):
                step = self.steps[state].get(c)
                if step is None:
                    self.ends.append(0)
                    self.steps.append({})
                    step = self.steps[state][c] = [len(self.ends) - 1, 0]
                step[1] += 1
                state = step[0]
            self.ends[state] += 1
        self._merge_states()

    def total(self, state: int) -> int:
        return self.ends[state] + sum(n for _, n in self.steps[state].values())

    def _alike(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            na, nb = self.total(a), self.total(b)
            if not na or not nb:
                continue
            limit = self.bound * (1 / math.sqrt(na) + 1 / math.sqrt(nb))
            if abs(self.ends[a] / na - self.ends[b] / nb) > limit:
                return False
            for c in self.steps[a].keys() | self.steps[b].keys():
                sa, sb = self.steps[a].get(c), self.steps[b].get(c)
                if abs((sa[1] if sa else 0) / na - (sb[1] if sb else 0) / nb) > limit:
                    return False
                if sa and sb and sa[0] != sb[0]:
                    todo.append((sa[0], sb[0]))
        return True

    def _fold(self, into: int, tree: int) -> None:
        """Adds the subtree of ``tree`` to the automaton at ``into``."""
        todo = [(into, tree)]
        while todo:
            a, b = todo.pop()
            self.ends[a] += self.ends[b]
            for c, (target, n) in self.steps[b].items():
                step = self.steps[a].get(c)
                if step is None:
                    self.steps[a][c] = [target, n]
                else:
                    step[1] += n
                    if step[0] != target:
                        todo.append((step[0], target))

    def _merge_states(self) -> None:
        settled = [0]
        while True:
            border = [(s, c, step[0]) for s in settled for c, step in sorted(self.steps[s].items()) if step[0] not in settled]
            if not border:
                break
            source, symbol, state = border[0]
            for other in settled:
                if self._alike(other, state):
                    self.steps[source][symbol][0] = other
                    self._fold(other, state)
                    break
            else:
                settled.append(state)
        self.states = len(settled)

    def log_likelihood(self, value: str) -> float:
        """Natural log; a step that was never seen counts as half an observation."""
        state, out = 0, 0.0
        kinds = len(_CLASSES) + 1
        for c in symbols(value):
            n = self.total(state)
            step = self.steps[state].get(c)
            out += math.log(((step[1] if step else 0) + 0.5) / (n + 0.5 * kinds) / _CLASSES[c])
            state = step[0] if step else 0
        return out + math.log((self.ends[state] + 0.5) / (self.total(state) + 0.5 * kinds))


class Formats:
    """Automata of the labelled kinds and the chances of characters in ordinary tokens.

    ``pairs`` and ``letters`` count the class pairs and the characters of all ordinary tokens.
    """

    def __init__(self, labelled: dict[str, list[str]], pairs: dict[str, int], letters: dict[str, int]):
        self.automata = {kind: Automaton(values) for kind, values in sorted(labelled.items()) if values}
        self.pairs, self.letters = Counter(pairs), Counter(letters)
        self.firsts, self.by_class = Counter(), Counter()
        for pair, n in pairs.items():
            self.firsts[pair[0]] += n
        for c, n in letters.items():
            self.by_class[symbols(c)] += n

    def background(self, value: str) -> float:
        kinds, marks, out = len(_CLASSES) + 1, symbols(value), 0.0
        for a, b in zip("^" + marks, marks + "$", strict=True):
            out += math.log((self.pairs[a + b] + 0.5) / (self.firsts[a] + 0.5 * kinds))
        for c, mark in zip(value, marks, strict=True):
            out += math.log((self.letters[c] + 0.5) / (self.by_class[mark] + 0.5 * _CLASSES[mark]))
        return out

    def advantage(self, value: str) -> float:
        """Best log likelihood ratio of a format over ordinary tokens, per character."""
        if not self.automata:
            return -math.inf
        return (max(a.log_likelihood(value) for a in self.automata.values()) - self.background(value)) / len(value)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Start, end and kind of every match that is long enough, in code points."""
    found = []
    for kind, pattern, least, group in PATTERNS:
        found += [(m.start(), m.end(), kind) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def values_of(text: str, spans: list[tuple[int, int, str]]) -> list[tuple[str, str]]:
    """Kind and credential of each span; an assignment's credential is what is assigned."""
    return [(kind, PATTERNS[0][1].match(text, start).group(2) if kind == "assign" else text[start:end]) for start, end, kind in spans]


def candidates(text: str, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Start, end and text of the tokens that no span touches."""
    out, k = [], 0
    reach = 0
    for m in TOKEN.finditer(text):
        while k < len(spans) and spans[k][0] < m.end():
            reach = max(reach, spans[k][1])
            k += 1
        if reach <= m.start():
            out.append((m.start(), m.end(), m.group()))
    return out


_FOUND = "doc_id long, base string, starts array<int>, ends array<int>, tokens array<string>, kinds array<string>, secrets array<string>"


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([
        ("doc_id", pa.int64()), ("base", pa.string()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())),
        ("tokens", pa.list_(pa.string())), ("kinds", pa.list_(pa.string())), ("secrets", pa.list_(pa.string())),
    ])
    for batch in batches:
        for low in range(0, len(batch), 500):
            rows = []
            part = batch.slice(low, 500)
            for i in range(len(part)):
                text = part.column(1)[i].as_py() or ""
                spans = base_spans(text)
                tokens = candidates(text, spans)
                labelled = values_of(text, spans)
                rows.append((
                    listed(spans), [t[0] for t in tokens], [t[1] for t in tokens], [t[2] for t in tokens],
                    [kind for kind, _ in labelled], [value for _, value in labelled],
                ))
            columns = [pa.array(c, schema.field(1 + k).type) for k, c in enumerate(zip(*rows, strict=True))]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], schema=schema)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per class pair (^ and $ at the ends) and per character of the task's tokens, with its count."""
    pairs, letters = Counter(), Counter()
    for batch in batches:
        for token in batch.column(0).flatten():
            value = token.as_py()
            marks = f"^{symbols(value)}$"
            letters.update(value)
            pairs.update(map("".join, zip(marks, marks[1:], strict=False)))
    rows = [("pair", *x) for x in pairs.items()] + [("letter", *x) for x in letters.items()]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["part", "key", "n"])


def ordinary_counts(found: DataFrame) -> tuple[dict[str, int], dict[str, int]]:
    """Class pairs and characters of every token of ``found(tokens)``, as often as they occur."""
    counted = found.select("tokens").mapInArrow(_counted, "part string, key string, n long")
    rows = counted.groupBy("part", "key").agg(F.sum("n").alias("n")).collect()  # at most 36 pairs and 67 characters
    pairs, letters = ({r.key: r.n for r in rows if r.part == part} for part in ("pair", "letter"))
    return pairs, letters


def _extended(formats, threshold: float):
    schema = pa.schema([("doc_id", pa.int64()), ("base", pa.string()), ("spans", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, bool] = {}
        for batch in batches:
            out = []
            for base, starts, ends, tokens in zip(*(batch.column(k).to_pylist() for k in range(1, 5)), strict=True):
                spans = [(int(a), int(b), kind) for kind, a, b in (s.split(":") for s in base.split(",") if s)]
                for start, end, token in zip(starts, ends, tokens, strict=True):
                    if token not in known:
                        if len(known) > 100_000:
                            known.clear()
                        known[token] = formats.value.advantage(token) >= threshold
                    if known[token]:
                        spans.append((start, end, "format"))
                out.append(listed(sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], schema=schema)

    return run


def find_secrets(docs: DataFrame, fit_values: int = FIT_VALUES, fit_length: int = FIT_LENGTH, threshold: float = ADVANTAGE,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, ``n_assign``, ``n_access``, ``n_hex``, ``base_sha256``, ``base``, ``spans``, ``n_format``.

    Spans are ``kind:start:end`` in code points, by start, comma-joined. The automata learn from at most
    ``fit_values`` different credentials of each kind, of those of up to ``fit_length`` characters the ones
    with the smallest hashes. The language model of ordinary tokens counts every occurrence of all of them;
    every token is scored. A null text is empty and has no spans. Ids may be null or repeat.
    An empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    found = written_table(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(_scanned, _FOUND), "secrets-found")
    both = F.explode(F.arrays_zip("kinds", "secrets")).alias("s")
    labels = found.select(both).select(F.col("s.kinds").alias("kind"), F.col("s.secrets").alias("value")).where(F.length("value") <= fit_length).distinct()
    labelled: dict[str, list[str]] = {}
    for kind in KINDS[:3]:
        rows = labels.where(F.col("kind") == kind).select("value").orderBy(F.xxhash64("value"), "value").limit(fit_values)
        labelled[kind] = [r[0] for r in rows.collect()]
    formats = spark.sparkContext.broadcast(Formats(labelled, *ordinary_counts(found)))
    spans = found.select("doc_id", "base", "starts", "ends", "tokens").mapInArrow(_extended(formats, threshold), "doc_id long, base string, spans string")
    count = lambda kind, c: (F.size(F.split(c, f"{kind}:")) - 1).cast("long")
    return spans.select(
        F.col("doc_id").alias(id_col), *(count(k, "base").alias(f"n_{k}") for k in KINDS[:3]), F.sha2("base", 256).alias("base_sha256"),
        "base", "spans", count("format", "spans").alias("n_format"),
    )
