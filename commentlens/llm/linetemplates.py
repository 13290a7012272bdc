"""Line de-duplication by a log-template tree, with DataFrame functions only.

A line goes down a tree of fixed depth: token count, then its first ``LEAD`` tokens, where a token
with a digit counts as variable. In a leaf, a position is constant if one token holds at least half
of the leaf's lines; the other positions are variable. A line of which at least ``ALIKE`` % of the
tokens are those constants or variable in itself has the leaf's template; any other line is its own.
Templates that ``min_docs`` documents have are dropped everywhere but in their first document. Lines
that are equal, apart from tokens with a digit, are dropped from the second document on: they need no
further evidence, while in a leaf of two lines each token would be constant.

Only hashes are counted, and counts combine before the shuffle, so a line that a third of all
documents have is one row per task. Token counts are taken in recurring leaves only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commentlens.session import written_table

LEAD = 3
ALIKE = 70
#: Documents from which a generalised template counts; equal lines count from the second document on.
MIN_DOCS = 3
_WILD = "<*>"
#: Stands for a null id, which sorts after all others.
NO_ID = (1 << 63) - 1


def _masked(text: Column) -> Column:
    """The lines of a text with single spaces, in which every token with a digit is variable; each pattern reads the text once."""
    plain = F.regexp_replace(text, r"[\x20\x09\x0B-\x0D]{2,}|[\x09\x0B-\x0D]", " ")
    # tried at the beginnings of tokens only, and without going back
    return F.split(F.regexp_replace(plain, r"(?<![^ \n])[^ \n0-9]*+[0-9][^ \n]*+", _WILD), "\n")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Key (id, sha) of each row with its text."""
    text = F.coalesce(docs[text_col], F.lit(""))
    return docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(NO_ID)).alias("id"), F.sha2(text, 256).alias("sha"), text.alias("text"))


def _leaved(rows: DataFrame, lead: int) -> DataFrame:
    """One row per line that isn't blank: key, pos, tokens, leaf, own (hash of the masked line)."""
    each = rows.select("id", "sha", F.posexplode(F.transform(_masked(F.col("text")), lambda x: F.trim(x))).alias("pos", "line")).where("line <> ''")
    each = each.select("id", "sha", "pos", "line", F.split("line", " ").alias("tokens"))
    leaf = F.xxhash64(F.size("tokens"), F.slice("tokens", 1, lead))
    return each.select("id", "sha", "pos", "tokens", leaf.alias("leaf"), F.xxhash64("line").alias("own"))


def drop_recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS, lead: int = LEAD, alike: int = ALIKE, with_text: bool = False,
                         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, ``n_lines``, ``n_dropped``, ``kept_sha256`` (and ``kept_text``).

    Lines are cut at line feeds; blank lines count as lines, have no template and always stay. The
    document with the smallest id keeps its lines of a template. ``min_docs`` holds for generalised
    templates only; equal masked lines go from the second document on. A null id is larger than all others.
    Rows of one id are one document. A null text is empty: one blank line. An empty table gives an
    empty result; other columns are ignored.
    """
    rows = _keyed(docs, id_col, text_col)
    keys = written_table(_leaved(rows, lead).select("id", "sha", "pos", "leaf", "own"), "lines-keys")
    per_line = keys.groupBy("leaf", "own").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count(F.lit(1)).alias("n"))
    per_line = written_table(per_line, "lines-kinds")
    # a leaf with one kind of line needs no template: its lines are equal anyway
    leaves = per_line.groupBy("leaf").agg(F.sum("n").alias("lines"), F.count(F.lit(1)).alias("kinds"), F.min("low").alias("low"), F.max("high").alias("high"))
    leaves = written_table(leaves.where(f"kinds > 1 AND lines >= {min_docs} AND low < high").select("leaf", "lines"), "lines-leaves")

    open_lines = _leaved(rows, lead).join(leaves.select("leaf"), "leaf", "left_semi").select("leaf", "id", "sha", "pos", "tokens")
    open_lines = written_table(open_lines, "lines-open")
    token = open_lines.select("leaf", F.posexplode("tokens").alias("at", "token"))
    counts = token.groupBy("leaf", "at", "token").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("leaf", "at").agg(F.max(F.struct("n", "token")).alias("best"))
    constant = F.when((F.col("best.n") * 2 >= F.col("lines")) & (F.col("best.token") != _WILD), F.col("best.token")).otherwise(_WILD)
    templates = (
        best.join(leaves, "leaf").select("leaf", F.struct("at", constant.alias("token")).alias("t"))
        .groupBy("leaf").agg(F.transform(F.array_sort(F.collect_list("t")), lambda t: t["token"]).alias("template"))
    )
    templates = written_table(templates, "lines-templates")
    hits = F.aggregate(
        F.zip_with("tokens", "template", lambda a, b: ((a == b) | (a == _WILD)).cast("int")), F.lit(0), lambda x, y: x + y)
    # at least one constant beyond the leading tokens, or the leaf says no more than its path
    fixed = F.exists(F.slice("template", lead + 1, 1 << 30), lambda t: t != _WILD) | (F.size("template") <= lead)
    joined = open_lines.join(templates, "leaf").where(fixed & (hits * 100 >= F.size("tokens") * alike)).select("leaf", "id", "sha", "pos").distinct()
    general = written_table(joined, "lines-general")
    wide = general.select("leaf", "id").distinct().groupBy("leaf").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("docs"))
    wide = written_table(wide.where(f"docs >= {min_docs}").select("leaf", "first"), "lines-recurring")
    equal = per_line.where("low < high").select("leaf", "own", F.col("low").alias("first"))
    gone = (
        keys.join(equal, ["leaf", "own"]).where("id > first").select("id", "sha", "pos")
        .unionByName(general.join(wide, "leaf").where("id > first").select("id", "sha", "pos")).distinct()
        .groupBy("id", "sha").agg(F.map_from_entries(F.collect_list(F.struct("pos", F.lit(True)))).alias("gone"))
    )
    gone = written_table(gone, "lines-gone")
    rows = rows.select("id", "sha", F.split("text", "\n").alias("lines"))
    kept = rows.join(gone, ["id", "sha"]).dropDuplicates(["id", "sha"]).withColumn(
        "kept", F.array_join(F.filter("lines", lambda x, i: F.coalesce(~F.element_at("gone", i), F.lit(True))), "\n"))
    kept = kept.select("id", "sha", F.size("gone").cast("long").alias("n_dropped"), F.sha2("kept", 256).alias("kept_sha"),
                       *(["kept"] if with_text else []))
    out = rows.select("id", "sha", F.size("lines").cast("long").alias("n_lines")).join(kept, ["id", "sha"], "left")
    return out.select(
        F.when(F.col("id") != NO_ID, F.col("id")).alias(id_col), "n_lines", F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
        F.coalesce("kept_sha", "sha").alias("kept_sha256"), *([F.col("kept").alias("kept_text")] if with_text else []),
    )
