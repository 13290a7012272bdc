import re

import pytest
import regex
from pyspark.sql import functions as F

from commentlens.functions import html
from commentlens.functions.lookalikes import spelling
from commentlens.functions.rulebook import AUTHOR_SCAM_PHRASES, RuleBook
from commentlens.operators import cascade

CASES = [
    ("bob", "hello there", "VALID", 15),
    ("text me on", "hello", "SCAM", 1),
    ("with no vid", "hello", "SELF_PROMO", 2),
    ("check video", "hello", "SCAM", 3),
    ("what an app", "hello", "SCAM", 4),
    ("what happened", "hello", "VALID", 15),
    ("bob", "my niece is burning", "SCAM", 5),
    ("bob", "ok is trash, my content is better", "SCAM", 6),
    ("bob", "get free vbucks http://a.example.com", "SCAM", 7),
    ("contact me", "find my username above", "SCAM", 8),
    ("bob", "the waffle house has found its new host", "OTHER_SPAM", 9),
    ("bob", "①②③④⑤⑥", "SCAM", 10),
    ("bob", "①②③④⑤", "VALID", 15),
    ("bob", "call ➕1 555", "SCAM", 11),
    ("bob", "call +1 555", "VALID", 15),
    ("bob", "here finally youtu.be/abc", "LINK_SPAM", 12),
    ("bob", "here finally", "VALID", 15),
    ("bob", "http://example.com", "LINK_ONLY", 13),
    ("bob", "look http://example.com now", "LINK_CONTAINS", 14),
    # look-alike glyphs, joiners, emoji aliases
    ("𝐭𝐞х𝐭 ｍе о𝐧", "hello", "SCAM", 1),
    ("t.e.x.t m*e o-n", "hello", "SCAM", 1),
    ("zvia igz", "hello", "VALID", 15),
    ("via ig", "hello", "SCAM", 1),
    ("@x 👉", "hello", "SCAM", 4),
    ("bob", "my пiеcе is bυrning", "VALID", 15),
    ("bob", "my niеcе is bυrning", "SCAM", 5),
    ("bob", "omg, exabbbbctly what i needed", "SCAM", 6),
    ("bob", "i appreciate and recommend ☝", "SCAM", 7),
    ("bob", "full video ▶️ youtube.com/x", "LINK_SPAM", 12),
    ("text me on", "http://example.com", "SCAM", 1),
]


def flagged(spark, rows, **options):
    df = spark.createDataFrame([(i, a, t) for i, (a, t) in enumerate(rows)], "i int, author_name string, text string")
    return [(r.rule_label, r.rule_id) for r in cascade.flag(df, **options).orderBy("i").collect()]


def test_hand_cases(spark):
    got = flagged(spark, [(a, t) for a, t, _, _ in CASES])
    assert [(c, g) for c, g in zip(CASES, got) if g != (c[2], c[3])] == []


def test_live_profile(spark):
    rows = [
        ("hack on tele", "hi"), ("hack on teleg", "hi"), ("@bob dmme", "☝ 🎁"), ("bob", "note: hi"),
        ("bob", "see http://example.com now"),
    ]
    assert flagged(spark, rows, live=True) == [
        ("VALID", 15), ("SCAM", 4), ("SCAM", 8), ("LINK_ONLY", 13), ("VALID", 15),
    ]
    df = spark.createDataFrame(
        [("bob", "see this", '<a href="http://x.org">x</a>'), ("bob", "see this", '<a href="/watch?v=abcdefghijk&amp;t=1">1</a>')],
        "author_name string, text string, html string",
    )
    assert [r.rule_label for r in cascade.flag(df, live=True, html="html").collect()] == ["LINK_CONTAINS", "VALID"]


def test_every_row_gets_one_verdict_and_filters_stay_above(spark):
    df = spark.createDataFrame([(a, t) for a, t, _, _ in CASES], "author_name string, text string")
    assert cascade.flag(df).count() == len(CASES)
    hits = cascade.flag(df).filter("rule_label <> 'VALID'")
    assert hits.count() == sum(c[2] != "VALID" for c in CASES)
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("waffle house") == 1 and plan.index("Filter") < plan.index("Generate")


def test_own_rule_lists(spark):
    book = RuleBook.from_lists({"text_combos": [["buy", "~not", "re:now+"]]})
    got = flagged(spark, [("bob", "buy nowww"), ("bob", "do not buy now")], book=book)
    assert got == [("SCAM", 7), ("VALID", 15)]


def test_canonical_spelling_equals_full_classes(spark):
    """Translating interchangeable glyphs and matching the short classes finds what the full classes find."""
    glyphs = spelling()
    words = []
    for letter in "aeilnoy":
        for glyph in sorted(glyphs.glyphs[letter]):
            words.append("on insta".replace(letter, glyph))
    full = regex.compile(_python(glyphs.pattern(("on insta",), canonical=False)))
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = [r[0] for r in df.select(glyphs.canonical(F.col("w")).rlike(glyphs.pattern(("on insta",)))).collect()]
    assert got == [bool(full.search(w)) for w in words]
    assert all(got)


@pytest.mark.parametrize("author, found", [
    ("\u039cy profile", True), ("\u00b5y profile", True),  # Greek capital Mu, micro sign
    ("rny profile", True), ("nny profile", False), ("my profi1e", True), ("my pr6file", True), ("my pr8file", False),
    ("my profil\U0001D7D1", True), ("my profil4", False),  # styled three, plain four
])
def test_letter_classes(author, found):
    pattern = _python(spelling().pattern(("my profile",), canonical=False))
    assert bool(regex.search(pattern, author)) == found


def _python(pattern):
    """The Java pattern for the ``regex`` module, nested sets included."""
    return "(?V1)" + re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: re.escape(chr(int(m.group(1), 16))), pattern)


@pytest.mark.parametrize("phrase", AUTHOR_SCAM_PHRASES)
def test_every_phrase_matches_itself(phrase):
    plain = phrase.replace(r"\b", "")
    assert regex.search(_python(spelling().pattern((phrase,))), plain)


def test_relabel_keeps_moderated(spark):
    df = spark.createDataFrame([("a", "bob", "hi", "SCAM", False)],
                               "comment_id string, author_name string, text string, label string, moderated boolean")
    assert cascade.relabel(df).first().asDict() == {
        "comment_id": "a", "author_name": "bob", "text": "hi", "label": "VALID", "moderated": False}


def test_only_links_of_the_body_count_when_asked(spark):
    df = spark.createDataFrame([
        ("bob", "look", "<a href='http://x.org'>x</a>"), ("bob", "look", "<a href='/u'>u</a><a class='a yt-simple-endpoint' href=\"http://x.org\">x</a>"),
    ], "author_name string, text string, html string")
    own = cascade.flag(df, live=True, html="html", link_class=html.BODY_LINK_CLASS).collect()
    assert [r.rule_label for r in own] == ["VALID", "LINK_CONTAINS"]
    assert [r.rule_label for r in cascade.flag(df, live=True, html="html").collect()] == ["LINK_CONTAINS"] * 2
