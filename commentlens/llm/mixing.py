"""Mixing to target weights by soft membership, with DataFrame functions and Spark ML only.

A classifier that is fitted on labelled rows gives every document a posterior over the domains. Then
document rates r >= 0 are fitted so that the expected tokens of each domain, sum of r * tokens * p,
meet the targets: least squares by projected gradient, each domain's residual being divided by its
current tokens. With that scaling the Gram matrix of the problem is stochastic, so a step of one is
safe for every table. An iteration is one aggregate of as many sums as there are domains; a document's
rate follows from the residuals so far, so nothing but those sums ever reaches the driver.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, Normalizer, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commentlens.llm.contain import words_of
from commentlens.session import written_table

#: Labelled rows that the classifier learns from at most, and the width of its features.
FIT_ROWS, FEATURES = 4000, 1 << 12
ROUNDS, TOLERANCE = 60, 1e-6
#: Share of tokens that each domain is to have.
TARGETS = {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15}


def _featured(docs: DataFrame, words: str, features: int) -> DataFrame:
    counts = HashingTF(inputCol=words, outputCol="__tf", numFeatures=features)
    return Normalizer(inputCol="__tf", outputCol="__features", p=1.0).transform(counts.transform(docs))


def fit_domains(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, features: int = FEATURES, id_col: str = "doc_id",
                text_col: str = "text", domain_col: str = "lang"):
    """The fitted classifier, or None if the labelled rows show fewer than two domains.

    It learns from at most ``fit_rows`` rows of the labelled table that are marked as of good quality
    and not toxic, those with the smallest id hashes. Rows without id, text or domain are left out.
    """
    good = labels.where((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0) & F.col(id_col).isNotNull())
    chosen = good.select(F.col(id_col).alias("__id")).distinct().orderBy(F.xxhash64("__id"), "__id").limit(fit_rows)
    rows = docs.select(docs[id_col].alias("__id"), words_of(docs[text_col]).alias("__words"), docs[domain_col].alias("__domain"))
    # at most fit_rows ids
    rows = rows.where("__domain IS NOT NULL AND __words[0] <> ''").join(F.broadcast(chosen), "__id", "left_semi")
    rows = written_table(rows, "mixing-fit")
    if rows.select("__domain").distinct().limit(2).count() < 2:
        return None
    steps = [
        StringIndexer(inputCol="__domain", outputCol="__label", stringOrderType="alphabetAsc"),
        LogisticRegression(featuresCol="__features", labelCol="__label", maxIter=20, regParam=1e-4, standardization=True),
    ]
    return Pipeline(stages=steps).fit(_featured(rows, "__words", features))


def posteriors(docs: DataFrame, model, domains: list[str], features: int = FEATURES, text_col: str = "text") -> DataFrame:
    """``docs`` with ``__tokens`` and ``__p``, an array of one probability per domain.

    A document without words has no tokens. Without a model all domains are equally likely.
    """
    words = words_of(docs[text_col])
    docs = docs.withColumn("__words", words).withColumn(
        "__tokens", F.when(F.element_at("__words", 1) == "", 0).otherwise(F.size("__words")).cast("long"))
    if model is None:
        return docs.drop("__words").withColumn("__p", F.array(*(F.lit(1.0 / len(domains)) for _ in domains)))
    indexer, classifier = model.stages
    scored = classifier.transform(_featured(docs, "__words", features)).withColumn("__all", vector_to_array("probability"))
    order = {name: i for i, name in enumerate(indexer.labels)}
    parts = [F.col("__all")[order[d]] if d in order else F.lit(0.0) for d in domains]
    return scored.select(*(c for c in docs.columns if c != "__words"), F.array(*parts).alias("__p"))


def _rate(history: list[list[float]]) -> Column:
    """The rate after the steps of ``history``: each subtracts p . step and stops at zero."""
    if not history:
        return F.lit(1.0)
    steps = F.array(*(F.array(*(F.lit(float(v)) for v in step)) for step in history))
    dot = lambda s: F.aggregate(F.zip_with(F.col("__p"), s, lambda a, b: a * b), F.lit(0.0), lambda x, y: x + y)
    return F.aggregate(steps, F.lit(1.0), lambda rate, s: F.greatest(F.lit(0.0), rate - dot(s)))


def fit_rates(rows: DataFrame, shares: list[float], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> Column:
    """The rate as a column of ``rows(__tokens, __p)``.

    The budget is the smallest with which no domain's total has to shrink. Domains without any
    expected tokens can't be met and keep no target.
    """
    k = len(shares)

    def totals(rate: Column) -> list[float]:
        weight = rate * F.col("__tokens")
        found = rows.select(weight.alias("w"), "__p").agg(*(F.coalesce(F.sum(F.col("w") * F.col("__p")[i]), F.lit(0.0)) for i in range(k))).first()
        return [float(v) for v in found]

    have = totals(F.lit(1.0))
    usable = [i for i in range(k) if have[i] > 0 and shares[i] > 0]
    if not usable:
        return F.lit(1.0)
    budget = max(have[i] / shares[i] for i in usable)
    target = [shares[i] * budget if have[i] > 0 else 0.0 for i in range(k)]
    history: list[list[float]] = []
    reached = have
    for _ in range(rounds):
        off = [(reached[i] - target[i]) / have[i] if have[i] > 0 else 0.0 for i in range(k)]
        if max(abs(o) * have[i] for i, o in enumerate(off)) <= tolerance * sum(target):
            break
        history.append(off)
        reached = totals(_rate(history))
    return _rate(history)


def mixed(docs: DataFrame, labels: DataFrame, targets: Mapping[str, float] = TARGETS, fit_rows: int = FIT_ROWS, features: int = FEATURES,
          rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """Every row of ``docs`` with ``tokens``, ``posterior``, ``rate`` and ``copies``.

    ``keep`` names the columns of ``docs`` to return (default all); ones that are called like the four
    new columns are replaced. ``rate`` is how often a document is to be read on average, ``copies`` a
    whole number with that mean: the fraction is rounded by a hash of id and text, so repeated rows
    agree. No row is dropped. Documents without words keep rate one. A null domain label only means
    that the row teaches nothing. An empty table gives an empty result.
    """
    domains = sorted(targets)
    total = sum(targets.values())
    names = [c for c in (docs.columns if keep is None else keep) if c not in ("tokens", "posterior", "rate", "copies")]
    model = fit_domains(docs, labels, fit_rows, features, id_col, text_col, domain_col)
    draw = F.pmod(F.xxhash64(docs[id_col], docs[text_col]), F.lit(1 << 20)) / float(1 << 20)
    rows = posteriors(docs.withColumn("__draw", draw), model, domains, features, text_col).select(*names, "__draw", "__tokens", "__p")
    rows = written_table(rows, "mixing-posteriors")
    rate = fit_rates(rows, [targets[d] / total for d in domains], rounds)
    rate = F.when(F.col("__tokens") == 0, F.lit(1.0)).otherwise(F.round(rate, 6))
    out = rows.withColumn("__rate", rate)
    copies = F.floor("__rate") + (F.col("__draw") < F.col("__rate") - F.floor("__rate")).cast("long")
    return out.select(
        *names, F.col("__tokens").alias("tokens"), F.transform("__p", lambda p: F.round(p, 6)).alias("posterior"),
        F.col("__rate").alias("rate"), copies.alias("copies"),
    )
