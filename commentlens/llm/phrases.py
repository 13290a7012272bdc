"""Phrase collocations by best-first branch-and-bound growth, each language's best 2000 exactly.

A phrase of two to four words scores 2,000,000 * a / (l + r), the lowest over its cuts into a first part
with l occurrences and a rest with r. No extension of a phrase q has more than f(q) occurrences and no
rest has fewer than the whole, so 2,000,000 * f(q) / (f(first part) + f(q)) bounds all phrases that begin
with q. Words and pairs are counted first. Then rounds grow the frontier: with tau at most the score that ranks
2000th among the phrases not known to be dropped, one pass over the texts counts the extensions of
every prefix whose bound reaches tau, the longer phrases around every phrase that reaches tau (they may
drop it) and the parts that a score still lacks. Rounds end when nothing that could matter is uncounted.

Tasks learn what to count from a broadcast table of flags by hash slot. Its size is fixed, whatever the
frontier; slots that collide make tasks count more, never less. Longer phrases travel as the 64-bit
numbers of their words, and counts combine before the shuffle. That no frequent word shares its number
with any other is checked over the whole vocabulary; if one does, other numbers are given.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from commentlens.llm.bytebpe import numbers
from commentlens.llm.wordhash import mix64
from commentlens.session import written_table

#: Least occurrences, longest phrase, phrases reported of each language, scale of a score.
LEAST, LONGEST, TOP, SCALE = 30, 4, 2000, 2_000_000
#: How many times the reported phrases a round grows.
MARGIN = 2
#: A phrase is dropped if a longer one has this share of its occurrences, in percent.
INSIDE = 80
#: Bytes of text that are split at a time, and words that a task holds before it passes its counts on.
SLICE_BYTES, HELD = 1 << 17, 1 << 17
#: Words whose phrases are counted at a time.
RUN = 1 << 18
#: Bounds of the flag table's size, as powers of two.
LEAST_BITS, MOST_BITS = 16, 24
#: What the texts are asked for: this phrase has LEAST occurrences; count what follows it; count what
#: precedes it; count it.
HEAVY, GROW, LEFT, SELF = 1, 2, 4, 8
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz .........")
#: Spark's settings for the passes over texts and encoded words.
_BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": "4194304", "spark.sql.parquet.columnarReaderBatchSize": "64"}
#: Rows that leave a task at a time.
_ROWS = 1 << 16
_WORDS = [f"w{k}" for k in range(1, LONGEST + 1)]


def word_hash(lang: str, word: bytes, seed: int) -> int:
    """The number of a word, never 0."""
    return xxhash.xxh64_intdigest(word, xxhash.xxh64_intdigest(lang.encode(), seed)) or 1


def longer_hash(phrase: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase and one more word."""
    return mix64(phrase * np.uint64(0x9FB21C651E98DF25) + word)


class Flags:
    """Flags by hash slot of phrases of one, two and three words."""

    def __init__(self, bits: int, seed: int = 0):
        self.bits, self.seed = bits, seed
        self.tables = {size: np.zeros(1 << bits, np.uint8) for size in (1, 2, 3)}

    def of(self, size: int, hashes: np.ndarray) -> np.ndarray:
        return self.tables[size][(hashes >> np.uint64(64 - self.bits)).astype(np.int64)]

    def added(self, rows: DataFrame) -> Flags:
        """These flags and those of ``rows(lang, phrase, size, flag)``."""
        out = Flags(self.bits, self.seed)
        packed = (
            rows.mapInArrow(_slots(self.bits, self.seed), "size int, slot long, flag long")
            .groupBy("size", F.shiftright("slot", 3).alias("at")).agg(F.expr("bit_or(shiftleft(flag, cast(8 * (slot & 7) as int)))").alias("flags"))
        )
        found = packed.collect()  # an eighth of the slots at most
        for size, table in self.tables.items():
            mine = [r for r in found if r["size"] == size]
            new = np.zeros(len(table) >> 3, np.int64)
            new[[r["at"] for r in mine]] = [r["flags"] for r in mine]
            out.tables[size] = table | new.astype("<i8").view(np.uint8)
        return out


def _slots(bits: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for lang, phrase, size, flag in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = [np.uint64(word_hash(lang, w, seed)) for w in phrase.encode().split(b" ")]
                value = np.array([words[0]], np.uint64)
                for w in words[1:]:
                    value = longer_hash(value, w)
                rows.append((size, int(value[0]) >> (64 - bits), flag))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64()), strict=True)],
                                                 names=["size", "slot", "flag"])

    return run


class _Language:
    """The words of one language in a task."""

    def __init__(self, lang: str, seed: int, flags: Flags | None = None):
        self.lang, self.seed, self.flags = lang, seed, flags
        self.carry = np.zeros(0, np.int64)
        self.reset()

    def reset(self) -> None:
        self.place = numbers({b".": 0})
        self.words, self.marks = [b"."], np.zeros(1, np.int64)
        self.singles = np.zeros(1, np.int64)

    def _numbered(self, data: bytes) -> np.ndarray:
        tokens, known = data.split(), len(self.place)
        out = np.fromiter(map(self.place.__getitem__, tokens), np.int64, len(tokens))
        if len(self.place) > known:
            new = list(islice(self.place, known, None))
            marks = np.array([word_hash(self.lang, w, self.seed) for w in new], np.uint64)
            if self.flags:
                marks = np.where(self.flags.of(1, marks) & HEAVY > 0, marks, np.uint64(0))
            self.words += new
            self.marks = np.concatenate([self.marks, marks.view(np.int64)])
        return out

    def count(self, data: bytes) -> None:
        """Adds the words of a slice of text to the counts."""
        found = self._numbered(data)
        self.singles = np.concatenate([self.singles, np.zeros(len(self.words) - len(self.singles), np.int64)])
        self.singles += np.bincount(found, minlength=len(self.words))

    def encode(self, data: bytes, goes_on: bool) -> tuple[np.ndarray, int]:
        """Numbers of the frequent words of a slice, 0 for others and between pieces, and how many of them the slice before had."""
        found = self._numbered(data)
        old, x = len(self.carry), np.concatenate([self.carry, self.marks[found]])
        self.carry = x[-(LONGEST - 1):] if goes_on else np.zeros(0, np.int64)
        if len(self.words) > HELD:
            self.reset()
        return x, old

    def told(self) -> Iterator[pa.RecordBatch]:
        """All word counts, and a row without phrase for their sum."""
        counts, marks = self.singles[1:], self.marks[1:]
        if len(counts):
            yield _batch(self.lang, {"phrase": pa.array([None], pa.string()), "w1": [0], "a": [int(counts.sum())]})
        for low in range(0, len(counts), _ROWS):
            part = slice(low, low + _ROWS)
            words = [w.decode() for w in self.words[1 + low:1 + low + len(counts[part])]]
            yield _batch(self.lang, {"phrase": words, "w1": marks[:len(counts)][part], "a": counts[part]})
        self.reset()


def _batch(lang: str, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(columns["a"]), pa.string()), *map(pa.array, columns.values())], names=["lang", *columns])


def _asked(x: np.ndarray, may_end: np.ndarray, sizes: tuple[int, ...], flags: Flags, done: Flags | None) -> Iterator[tuple[int, np.ndarray]]:
    """For each size, where phrases begin that the flags ask for and earlier passes did not count.

    ``x`` has the numbers of words, 0 where no phrase goes on; ``may_end`` says which words are not repeated from a slice before.
    """
    n = len(x)
    if n < 2:
        return
    word, h = x != 0, x.view(np.uint64)
    pair = word[:-1] & word[1:]
    if 2 in sizes:
        yield 2, np.flatnonzero(pair & may_end[1:])
        return
    if n < 3:
        return
    two = longer_hash(h[:-1], h[1:])
    first, first_done = flags.of(2, two), done.of(2, two)
    pair &= first & HEAVY > 0
    at = np.flatnonzero(pair[:-1] & pair[1:])
    three = longer_hash(two[at], h[at + 2])
    second, second_done = np.zeros(n - 2, np.uint8), np.zeros(n - 2, np.uint8)
    second[at], second_done[at] = flags.of(3, three), done.of(3, three)

    def triple(f2: np.ndarray, f3: np.ndarray) -> np.ndarray:
        return (f2[at] & GROW | f2[at + 1] & LEFT | f3[at] & SELF) > 0

    yield 3, at[triple(first, second) & ~triple(first_done, second_done) & may_end[at + 2]]
    at = at[(at < n - 3) & pair[np.minimum(at + 2, n - 2)]]

    def quadruple(f3: np.ndarray) -> np.ndarray:
        return (f3[at] & GROW | f3[at + 1] & LEFT) > 0

    yield 4, at[quadruple(second) & ~quadruple(second_done) & may_end[at + 3]]


def _phrases(x: np.ndarray, may_end: np.ndarray, sizes: tuple[int, ...], flags: Flags, done: Flags | None) -> Iterator[dict]:
    """Numbers and counts of the asked phrases of one run of words."""
    known, inverse = np.unique(x, return_inverse=True)
    for size, starts in _asked(x, may_end, sizes, flags, done):
        if not len(starts):
            continue
        places = [inverse[starts + k].astype(np.int64) for k in range(size)]
        high, low = places[0] << 32 | places[1], None
        if size > 2:
            low = places[2] << 32 | (places[3] if size > 3 else 0)
        order = np.argsort(high) if low is None else np.lexsort((low, high))
        high, low = high[order], None if low is None else low[order]
        fresh = high[1:] != high[:-1]
        if low is not None:
            fresh |= low[1:] != low[:-1]
        begins = np.flatnonzero(np.concatenate([[True], fresh]))
        count = np.diff(np.concatenate([begins, [len(high)]]))
        first = [known[p[order[begins]]] for p in places]
        for at in range(0, len(begins), _ROWS):
            part = slice(at, at + _ROWS)
            zeros = np.zeros(len(count[part]), np.int64)
            yield {w: first[k][part] if k < size else zeros for k, w in enumerate(_WORDS[:max(sizes)])} | {"a": count[part]}


def _slices(texts: Iterator[bytes]) -> Iterator[tuple[bytes, bool]]:
    """Lower-cased text in which every separator is a word of its own, and whether the text goes on in the next slice."""
    held, size = [], 0
    for raw in texts:
        text = raw.translate(_TABLE).replace(b".", b" . ")
        low = 0
        while len(text) - low > SLICE_BYTES:
            at = text.rfind(b" ", low + 1, low + SLICE_BYTES)
            at = at if at > 0 else text.find(b" ", low + SLICE_BYTES)
            if at < 0:
                break
            if held:
                yield b" . ".join(held), False
                held, size = [], 0
            yield text[low:at], True
            low = at
        held.append(text[low:])
        size += len(text) - low
        if low or size > SLICE_BYTES:
            yield b" . ".join(held), False
            held, size = [], 0
    if held:
        yield b" . ".join(held), False


def _read(batches: Iterator[pa.RecordBatch], languages: dict[str, _Language], make) -> Iterator[tuple[_Language, bytes, bool]]:
    """Language, text and whether it goes on of all slices of the batches."""
    for batch in batches:
        rows: dict[str, list[int]] = {}
        for row, lang in enumerate(batch.column(0).to_pylist()):
            rows.setdefault(lang, []).append(row)
        texts = batch.column(1)
        for lang, mine in rows.items():
            language = languages.setdefault(lang, make(lang))
            for data, goes_on in _slices((texts[i].as_py() or "").encode() for i in mine):
                yield language, data, goes_on


def _word_counter(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages: dict[str, _Language] = {}
        for language, data, _ in _read(batches, languages, lambda lang: _Language(lang, seed)):
            language.count(data)
            if sum(len(x.words) for x in languages.values()) > HELD:
                for x in languages.values():
                    yield from x.told()
        for language in languages.values():
            yield from language.told()

    return run


def _encoder(flags):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = flags.value
        for language, data, goes_on in _read(batches, {}, lambda lang: _Language(lang, asked.seed, asked)):
            x, old = language.encode(data, goes_on)
            if x.any():
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.list_(pa.int64())), pa.array([old], pa.int32())], names=["x", "old"])

    return run


def _phrase_counter(sizes: tuple[int, ...], flags, done):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, before = flags.value, done and done.value
        held: list[tuple[np.ndarray, int]] = []

        def counted() -> Iterator[pa.RecordBatch]:
            # numbers differ between languages, so runs of different ones can be counted together
            x = np.concatenate([v for run in held for v in (run[0], np.zeros(1, np.int64))])
            may_end = np.concatenate([np.arange(len(v) + 1) >= old for v, old in held])
            held.clear()
            for columns in _phrases(x, may_end, sizes, asked, before):
                yield pa.RecordBatch.from_arrays(list(map(pa.array, columns.values())), names=list(columns))

        waiting = 0
        for batch in batches:
            for x, old in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                held.append((x.values.to_numpy(), old))
                waiting += len(x.values)
                if waiting > RUN:
                    waiting = 0
                    yield from counted()
        if held:
            yield from counted()

    return run


def _vocabulary(texts: DataFrame, least: int) -> tuple[int, DataFrame, DataFrame]:
    """A seed under which no frequent word of any language shares its number, the sums of all words by language, and the frequent words."""
    for seed in range(1 << 30):
        parts = texts.mapInArrow(_word_counter(seed), "lang string, phrase string, w1 long, a long")
        with _small_batches(texts.sparkSession):
            words = written_table(parts.groupBy("lang", "phrase", "w1").agg(F.sum("a").cast("long").alias("a")), "phrases-words")
        shared = words.where("phrase IS NOT NULL").groupBy("w1").agg(F.count(F.lit(1)).alias("n"), F.max("a").alias("a"))
        if shared.where(f"n > 1 AND a >= {least}").isEmpty():
            frequent = words.where(F.col("phrase").isNotNull() & (F.col("a") >= least))
            return seed, words.where("phrase IS NULL").select("lang", F.col("a").alias("n")), written_table(frequent, "phrases-frequent")
    raise RuntimeError("no collision-free numbers")


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Rows reach the tasks a few megabytes at a time, as rows of encoded words are long; the session's own settings come back after."""
    own = {k: spark.conf.get(k) for k in _BATCHES}
    for k, v in _BATCHES.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in own.items():
            spark.conf.set(k, v)


def _counted(encoded: DataFrame, words: DataFrame, name: str, least: int, sizes: tuple[int, ...], flags: Flags, done: Flags | None = None) -> DataFrame:
    """Phrases of the asked sizes with their occurrences, from ``least`` on."""
    context, names = encoded.sparkSession.sparkContext, _WORDS[:max(sizes)]
    schema = ", ".join(f"{c} long" for c in (*names, "a"))
    parts = encoded.mapInArrow(_phrase_counter(sizes, context.broadcast(flags), done and context.broadcast(done)), schema)
    with _small_batches(encoded.sparkSession):
        spelt = written_table(parts.groupBy(*names).agg(F.sum("a").cast("long").alias("a")).where(F.col("a") >= least), f"{name}-numbers")
    # the first word's number tells the language
    spelt = spelt.join(words.select("lang", "w1", F.col("phrase").alias("text_w1")), "w1")
    for w in names[1:]:
        spelt = spelt.join(words.select(F.col("w1").alias(w), F.col("phrase").alias(f"text_{w}")), w, "left")
    size = sum(((F.col(w) != 0).cast("int") for w in names), F.lit(0))
    return written_table(spelt.select("lang", F.concat_ws(" ", *(f"text_{w}" for w in names)).alias("phrase"), size.alias("size"), "a"), name)


def _ratio(a: Column, below: Column) -> Column:
    """floor(SCALE * a / below), exactly: the product has up to 26 digits."""
    return F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * a.cast("decimal(20,0)"), below.cast("decimal(20,0)")).cast("long")


def _scored(known: DataFrame) -> DataFrame:
    """All counted phrases of two words and more with l, r, score, bound, missing parts and the most occurrences of a longer phrase.

    Where the count of a part is missing, the phrase's own stands for it, and the score is an upper bound.
    """
    counts = known.select(F.col("lang").alias("in_lang"), F.col("phrase").alias("part"), F.col("a").alias("f"))
    cuts = known.where("size > 1").select("lang", "phrase", "size", "a", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("*", F.expr("substring_index(phrase, ' ', k)").alias("head"), F.expr("substring_index(phrase, ' ', k - size)").alias("tail"))
    sides = cuts
    for side, f in (("head", "l"), ("tail", "r")):
        other = counts.withColumnRenamed("f", f)
        sides = sides.join(other, (sides["lang"] == other["in_lang"]) & (sides[side] == other["part"]), "left").drop("in_lang", "part")
    missing = F.filter(F.array(F.when(F.col("l").isNull(), F.col("head")), F.when(F.col("r").isNull(), F.col("tail"))), lambda p: p.isNotNull())
    sides = sides.withColumn("missing", missing).withColumn("l", F.coalesce("l", "a")).withColumn("r", F.coalesce("r", "a"))
    best = sides.groupBy("lang", "phrase", "size", "a").agg(
        F.min(F.struct(_ratio(F.col("a"), F.col("l") + F.col("r")).alias("score"), "k", "l", "r")).alias("cut"),
        F.min(_ratio(F.col("a"), F.col("l") + F.col("a"))).alias("bound"),
        F.array_distinct(F.flatten(F.collect_list("missing"))).alias("missing"),
    )
    longer = known.where("size > 2").select(
        "lang", F.explode(F.array(F.expr("substring_index(phrase, ' ', size - 1)"), F.expr("substring_index(phrase, ' ', 1 - size)"))).alias("phrase"), "a")
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    out = best.join(longer, ["lang", "phrase"], "left")
    big = lambda c, f: F.col(c).cast("decimal(20,0)") * f
    dropped = F.coalesce(big("longer", 100) >= big("a", INSIDE), F.lit(False))
    return out.select("lang", "phrase", "size", "a", "cut.l", "cut.r", "cut.score", "bound", "missing", dropped.alias("dropped"))


def _ranked(scored: DataFrame, top: int) -> DataFrame:
    """The best phrases of each language among those that are settled and not dropped; ranks limit each task before the shuffle."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return scored.where(~F.col("dropped") & (F.size("missing") == 0)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _wanted(scored: DataFrame, top: int) -> DataFrame:
    """lang, phrase, size, flag of all that must be counted while the best are as they seem.

    ``MARGIN`` times ``top`` are looked at, as some will be dropped: fewer rounds for a somewhat wider frontier.
    """
    tau = _ranked(scored, MARGIN * top).groupBy("lang").agg(F.when(F.count(F.lit(1)) >= MARGIN * top, F.min("score")).otherwise(0).alias("tau"))
    rows = scored.where(~F.col("dropped") | (F.col("size") < LONGEST)).join(tau, "lang", "left").withColumn("tau", F.coalesce("tau", F.lit(0)))
    contends = ~F.col("dropped") & (F.size("missing") == 0) & (F.col("score") >= F.col("tau"))
    short = F.col("size") < LONGEST
    asks = F.array(
        F.when(short & ((F.col("bound") >= F.col("tau")) | contends), F.struct("phrase", "size", F.lit(GROW).alias("flag"))),
        F.when(short & contends, F.struct("phrase", "size", F.lit(LEFT).alias("flag"))),
    )
    lacking = F.when(~F.col("dropped") & (F.col("score") >= F.col("tau")), F.transform("missing", lambda p: F.struct(p.alias("phrase"), F.lit(LONGEST - 1).alias("size"), F.lit(SELF).alias("flag"))))
    asks = F.filter(F.concat(asks, F.coalesce(lacking, F.array().cast("array<struct<phrase:string,size:int,flag:int>>"))), lambda x: x.isNotNull())
    return rows.select("lang", F.explode(asks).alias("ask")).select("lang", "ask.*").distinct()


def _flag_bits(rows: int) -> int:
    return min(max(LEAST_BITS, (4 * rows).bit_length()), MOST_BITS)


def _marked(rows: DataFrame) -> DataFrame:
    return rows.select("lang", "phrase", "size", F.lit(HEAVY).alias("flag"))


def collocations(docs: DataFrame, top: int = TOP, least: int = LEAST, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Each language's ``top`` phrases: lang, rank, phrase, a, l, r, n, score.

    A-Z are lower-cased; pieces end at ``. , ; : ! ?`` and line breaks, words at spaces and tabs. ``a``, ``l`` and ``r`` are
    the occurrences of the phrase and of the parts at its lowest-scoring cut (the first of equal ones), ``n`` those of all
    words of the language. Phrases have ``least`` occurrences or more; one inside a longer such phrase that has 80 % of its
    occurrences is dropped. Order: score, occurrences, then the phrase's bytes. A null language is ``und``, a null text is
    empty. Repeated rows count each time. A language with fewer phrases has them all; one without any has no row. Texts of
    any length are counted whole. An empty table gives an empty result; other columns are ignored.
    """
    spark: SparkSession = docs.sparkSession
    texts = docs.select(F.coalesce(docs[lang_col], F.lit("und")).alias("lang"), docs[text_col].alias("text"))
    seed, totals, words = _vocabulary(texts, least)
    singles = words.select("lang", "phrase", F.lit(1).alias("size"), "a")
    flags = Flags(_flag_bits(words.count()), seed).added(_marked(singles))
    # from here on only the numbers of frequent words are read; parquet keeps them as places in a list
    encoded = texts.mapInArrow(_encoder(texts.sparkSession.sparkContext.broadcast(flags)), "x array<long>, old int")
    with _small_batches(spark):
        encoded = written_table(encoded, "phrases-encoded")
    pairs = _counted(encoded, words, "phrases-pairs", least, (2,), flags)
    done = Flags(max(flags.bits, _flag_bits(pairs.count())), seed).added(_marked(singles.unionByName(pairs)))
    known, asked = singles.unionByName(pairs), None
    while True:
        scored = written_table(_scored(known), "phrases-scored")
        wanted = _wanted(scored, top)
        fresh = wanted if asked is None else wanted.join(asked, ["lang", "phrase", "size", "flag"], "left_anti")
        fresh = written_table(fresh, "phrases-asked")
        if fresh.isEmpty():
            break
        flags = done.added(fresh)
        known = known.unionByName(_counted(encoded, words, "phrases-grown", least, (3, 4), flags, done))
        done, asked = flags, fresh if asked is None else asked.unionByName(fresh)
    best = _ranked(scored, top).join(totals, "lang")
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
