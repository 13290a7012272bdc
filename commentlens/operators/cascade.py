"""The ordered rule cascade: first match wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commentlens.functions import html as html_fn
from commentlens.functions import matching, text as text_fn, urls
from commentlens.functions.lookalikes import spelling
from commentlens.functions.rulebook import RuleBook

# Cascade order and the label each rule gives.
RULES = (
    (1, "author_scam", "SCAM"),
    (2, "author_no_video", "SELF_PROMO"),
    (3, "author_ad", "SCAM"),
    (4, "author_combo", "SCAM"),
    (5, "text_scam", "SCAM"),
    (6, "text_filled", "SCAM"),
    (7, "text_combo", "SCAM"),
    (8, "pair_combo", "SCAM"),
    (9, "known_spam", "OTHER_SPAM"),
    (10, "styled_digits", "SCAM"),
    (11, "disguised_phone", "SCAM"),
    (12, "link_spam", "LINK_SPAM"),
    (13, "link_only", "LINK_ONLY"),
    (14, "link_contains", "LINK_CONTAINS"),
    (15, "none", "VALID"),
)

_A, _T, _NA, _NT, _CA, _CT, _RULE = "__a", "__t", "__na", "__nt", "__ca", "__ct", "__rule"
# a text holds more than plain ASCII; a text without repeats of buffer characters
_ODD, _RUNS = "_odd", "_runs"


def _surface(df: DataFrame, author: str, text: str, live: bool, book: RuleBook) -> DataFrame:
    """Each layer is its own projection, so the optimizer computes every derived text once.

    A text of plain ASCII has nothing to strip, decompose or fold once its white space is collapsed: one test per text
    spares it all patterns but the ones that can change it.
    """
    glyphs = spelling(book.lookalikes)
    if live:
        spaces, runs, shown = text_fn.collapse_long_spaces, lambda x: x, {_A: lambda x: x, _T: lambda x: x}
        normal, odd = text_fn.normalise_browser, text_fn.NOT_PLAIN_LIVE
    else:
        spaces, runs = text_fn.collapse_whitespace, text_fn.collapse_buffer_runs
        shown = {_A: text_fn.strip_categories, _T: lambda x: text_fn.strip_categories(text_fn.collapse_buffer_runs(x))}
        normal, odd = text_fn.normalise, text_fn.NOT_PLAIN
    rows = df.withColumns({_A: spaces(F.col(author)), _T: spaces(F.col(text))})
    rows = rows.withColumns({name + kind: test for name in (_A, _T) for kind, test in (
        (_ODD, F.col(name).rlike(odd)), (_RUNS, runs(F.col(name))))})
    plain_author = F.col(_A)
    plain_text = F.col(_T + _RUNS)
    rows = rows.withColumns({
        name: F.when(F.col(name + _ODD), shown[name](F.col(name))).otherwise(plain) for name, plain in ((_A, plain_author), (_T, plain_text))})
    return rows.withColumns({
        made: F.when(F.col(name + _ODD), change(F.col(name))).otherwise(easy)
        for name, made, change, easy in (
            (_A, _NA, normal, F.lower(_A + _RUNS)), (_T, _NT, normal, F.lower(_T + _RUNS)),
            (_A, _CA, glyphs.canonical, F.col(_A)), (_T, _CT, glyphs.canonical, F.col(_T)))})


def _tests(book: RuleBook, live: bool, html: str | None, link_class: str | None) -> dict[str, Column]:
    glyphs = spelling(book.lookalikes)
    a, t, na, nt, ca, ct = (F.col(c) for c in (_A, _T, _NA, _NT, _CA, _CT))
    combined = F.concat(a, F.lit(" "), t)

    def spelt(text: Column, phrases: tuple) -> Column:
        return text.rlike(glyphs.pattern(phrases)) if phrases else F.lit(False)

    tests = {
        "author_scam": spelt(ca, book.author_scam),
        "author_no_video": spelt(ca, book.author_no_video),
        "author_ad": spelt(ca, book.author_ad),
        "author_combo": matching.any_combo(na, book.author_combos),
        "text_scam": spelt(ct, book.text_scam),
        "text_filled": matching.filled_phrases(nt, book.text_filled),
        "text_combo": matching.any_combo(nt, book.text_combos),
        "pair_combo": matching.any_pair_combo(na, nt, book.pair_combos),
        "known_spam": matching.any_combo(nt, book.known_spam),
        "styled_digits": matching.has_styled_digits(combined),
        "disguised_phone": matching.has_disguised_phone(combined),
        "link_spam": nt.rlike(book.video_link) & matching.any_combo(nt, book.link_combos),
    }
    if live:
        tests["link_only"] = urls.is_absolute_url(t)
        tests["link_contains"] = html_fn.has_clickable_link(F.col(html), link_class) if html else F.lit(False)
    else:
        tests["link_only"] = urls.is_only_url(t)
        tests["link_contains"] = urls.contains_url(t)
    return tests


def flag(
    df: DataFrame,
    author: str = "author_name",
    text: str = "text",
    book: RuleBook | None = None,
    live: bool = False,
    html: str | None = None,
    link_class: str | None = None,
) -> DataFrame:
    """Add ``rule_id`` (1..15) and ``rule_label``.

    ``live`` selects the browser profile; it reads clickable links from the ``html`` column, of anchors with ``link_class``
    (``html.BODY_LINK_CLASS`` for whole rendered comments) or of any.
    """
    book = book or (RuleBook.live() if live else RuleBook())
    tests = _tests(book, live, html, link_class)
    rows = _surface(df, author, text, live, book)
    # three projections keep each generated method small; a later one looks at a row only
    # where the earlier ones found nothing
    decided = F.lit(None).cast("bigint")
    for first, last in ((1, 4), (5, 9), (10, len(RULES) - 1)):
        verdict = F.when(decided.isNotNull(), decided)
        for rule_id, name, _ in RULES[first - 1:last]:
            verdict = verdict.when(tests[name], F.lit(rule_id).cast("bigint"))
        rows = rows.withColumn(_RULE, verdict)
        decided = F.col(_RULE)
    found = F.coalesce(decided, F.lit(RULES[-1][0]).cast("bigint")).alias("rule_id")
    # the one-row generator keeps later filters on the verdict from being pushed below the
    # cascade, where they would evaluate all of it a second time
    return (
        rows.select(*df.columns, F.inline(F.array(F.struct(found))))
        .withColumn("rule_label", label_of_rule(F.col("rule_id")))
    )


def label_of_rule(rule_id: Column) -> Column:
    return F.element_at(F.array(*(F.lit(label) for _, _, label in RULES)), rule_id.cast("int"))


def relabel(df: DataFrame, **options) -> DataFrame:
    """Write the rule label to every row; ``moderated`` stays as it is."""
    columns = df.columns
    return flag(df, **options).withColumn("label", F.col("rule_label")).select(*columns)


def rules_then_model(rule_label: Column, model_label: Column, use_rules: Column | None = None) -> Column:
    """The rule verdict unless it is VALID, else the model verdict, else VALID."""
    decided = rule_label != "VALID"
    if use_rules is not None:
        decided = decided & use_rules
    return F.when(decided, rule_label).otherwise(F.coalesce(model_label, F.lit("VALID")))
