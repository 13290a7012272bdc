"""Benchmark decontamination: size-partitioned MinHash containment search, with DataFrame functions only.

A short item inside a long document has almost no Jaccard similarity with it, so the document's own
MinHash cannot show it. Instead each item has a bottom-k MinHash sketch, and documents are searched
for its members. Items are partitioned by size: in the partition of items up to u shingles, an item
of which a share t is contained misses at most (1 - t) * u shingles, so of floor((1 - t) * u) + 1
sketch members the document has at least one; an item of n shingles needs all but (1 - t) * n. No
contained item can be missed. Shingles that fewer items hold come first in the sketch, the hash decides
among equals, so that a passage which many items share is sketched only where nothing else is left.

Equal texts are one document until the end, and documents with equal sets of sketch members, or of item
shingles, are compared with the items once. Candidates are verified on all shingles, as texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from commentlens.llm.wordhash import SPACE
from commentlens.session import broadcast_if_small, written_table

SHINGLE = 5
PERCENT = 80
#: Texts that go on to the comparison are picked out by a broadcast of 8 bytes each, up to this many.
MARKS = 2_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; a null or blank text has one empty word."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")
    return F.split(F.translate(F.trim(plain), UPPER, LOWER), " ")


def _shingles(words: str, size: int, each) -> Column:
    """``each`` of every ``size`` consecutive words; nothing if there are fewer."""
    places = F.sequence(F.lit(0), F.size(words) - size)
    cut = F.transform(places, lambda i: each(*(F.get(F.col(words), i + k) for k in range(size))))
    return F.when(F.size(words) >= size, cut)


def _texts(words: str, size: int) -> Column:
    return _shingles(words, size, lambda *w: F.concat_ws(" ", *w))


def _hashes(words: str, size: int) -> Column:
    """Hashes of all shingles; each word is hashed once."""
    return _shingles(words, size, lambda *w: F.xxhash64(*w))


def _classes(sets: DataFrame, key: str, member: str, name: str) -> tuple[DataFrame, DataFrame]:
    """Keys with equal sets of members share a class: (key, class) and (class, member)."""
    whole = sets.groupBy(key).agg(F.sort_array(F.collect_set(member)).alias("all"))
    whole = written_table(whole.select(key, F.sha2(F.to_json("all"), 256).alias("class"), "all"), name)
    return whole.select(key, "class"), whole.groupBy("class").agg(F.first("all").alias("all")).select("class", F.explode("all").alias(member))


def _held_by(rows: DataFrame, keys: DataFrame, marks: int) -> DataFrame:
    """The rows whose ``key`` is in ``keys``; hashes of the keys drop nearly all others before the shuffle, if they are few enough."""
    listed = keys.select(F.xxhash64("key").alias("mark")).distinct()
    return rows.withColumn("mark", F.xxhash64("key")).join(broadcast_if_small(listed, marks), "mark", "left_semi").drop("mark").join(keys.select("key"), "key", "left_semi")


def contaminated(docs: DataFrame, items: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id",
                 item_col: str = "item_id", text_col: str = "text", with_digest: bool = False, marks: int = MARKS) -> DataFrame:
    """Pairs of a document and an item of which it holds ``percent`` % of the distinct shingles.

    Columns: the two ids, ``n_item`` and ``n_found`` shingles, ``containment`` (and ``text_sha256`` of the document). Each
    row is judged by its own text; rows of equal id and text give one row per item. Rows without id are judged alike and
    reported with a null id. Items of one id are one item, and so are items without id. Null or empty texts and items below
    ``shingle`` words have no shingles and match nothing. Empty tables give an empty result; other columns are ignored.
    """
    no_item = F.struct(items[item_col].isNull().alias("none"), items[item_col].alias("id"))
    listed = items.select(no_item.alias("item"), words_of(items[text_col]).alias("words"))
    listed = listed.select("item", F.explode(_texts("words", shingle)).alias("text")).distinct()
    listed = listed.withColumn("hashed", F.transform(F.split("text", " "), lambda w: F.xxhash64(w)))
    listed = written_table(listed.select("item", "text", F.xxhash64(*(F.get("hashed", F.lit(k)) for k in range(shingle))).alias("h")), "contain-items")
    sizes = written_table(listed.groupBy("item").agg(F.count(F.lit(1)).alias("n_item")), "contain-sizes")
    holders = listed.groupBy("h").agg(F.countDistinct("item").alias("holders"))
    # size partitions end at powers of two
    bound = F.pow(F.lit(2), F.ceil(F.log2("n_item")))
    order = Window.partitionBy("item").orderBy("holders", F.xxhash64("h"), "h")
    sketch = (
        listed.select("item", "h").distinct().join(holders, "h").join(sizes, "item")
        .withColumn("k", F.floor(bound * (100 - percent) / 100) + 1).withColumn("rank", F.row_number().over(order)).where("rank <= k")
        .select("item", "h", "n_item")
    )
    sketch = written_table(sketch, "contain-sketch")
    spare = F.floor(F.col("n_item") * (100 - percent) / 100)
    needed = sketch.groupBy("item", "n_item").agg(F.count(F.lit(1)).alias("members"))
    needed = needed.select("item", F.greatest(F.col("members") - spare, F.lit(1)).alias("needed"))

    plain = docs.select(F.sha2(F.coalesce(docs[text_col], F.lit("")), 256).alias("key"), docs[text_col].alias("text"))
    hashed = plain.select("key", F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)).alias("words"))
    hits = hashed.select("key", F.explode(_hashes("words", shingle)).alias("h")).join(sketch.select("h").distinct(), "h").distinct()
    seen, members = _classes(hits, "key", "h", "contain-seen")
    candidates = members.join(sketch, "h").groupBy("class", "item").agg(F.count(F.lit(1)).alias("n"))
    candidates = written_table(candidates.join(needed, "item").where("n >= needed").select("class", "item"), "contain-candidates")

    open_keys = seen.join(candidates.select("class").distinct(), "class", "left_semi").select("key", F.col("class").alias("first"))
    open_keys = written_table(open_keys, "contain-open")
    # texts are cut into words behind the shuffle
    held = _held_by(plain, open_keys, marks).select("key", words_of(F.col("text")).alias("words")).select("key", F.explode(F.array_distinct(_texts("words", shingle))).alias("text"))
    held = held.join(listed.select("text").distinct(), "text", "left_semi").distinct()
    full, texts = _classes(held, "key", "text", "contain-held")
    pairs = full.join(open_keys, "key").select("class", "first").distinct().join(candidates.withColumnRenamed("class", "first"), "first").select("class", "item").distinct()
    found = texts.join(listed.select("item", "text"), "text").join(pairs, ["class", "item"]).groupBy("class", "item").agg(F.count(F.lit(1)).alias("n_found"))
    found = found.join(sizes, "item").where(F.col("n_found") * 100 >= F.col("n_item") * percent)
    found = written_table(full.join(found, "class").select("key", "item", "n_item", "n_found"), "contain-found")

    named = docs.select(docs[id_col].alias("doc"), F.sha2(F.coalesce(docs[text_col], F.lit("")), 256).alias("key"))
    named = _held_by(named, found.select("key").distinct(), marks).distinct()
    return named.join(found, "key").select(
        F.col("doc").alias(id_col), F.col("item.id").alias(item_col), "n_item", "n_found", (F.col("n_found") / F.col("n_item")).alias("containment"),
        *([F.col("key").alias("text_sha256")] if with_digest else []),
    )
