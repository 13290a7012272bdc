import itertools
import random
import unicodedata

import pytest
import regex
from pyspark.sql import functions as F

from commentlens.functions import emoji, text
from commentlens.functions.lookfold import fold_map


def run(spark, values, function):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r[0] for r in rows.orderBy("i").select(function(F.col("s")).alias("r")).collect()]


def plain_normalise(value):
    """The same chain, one character at a time."""
    value = unicodedata.normalize("NFKD", emoji.demojize(value))
    value = "".join(fold_map().get(c, c) for c in value)
    value = "".join(c for c in value if unicodedata.category(c) not in text.STRIPPED_CATEGORIES)
    value = " ".join(value.split())
    groups = itertools.groupby(value)
    return "".join(c if c in text.BUFFER_CHARS else "".join(g) for c, g in groups).lower()


@pytest.mark.parametrize("given, expected", [
    ("CLAIM 𝟏𝟎𝐊 𝐕𝐁𝐔𝐂𝐊𝐒", "claim 10k vbucks"),
    ("ᴀʙc", "abc"),
    ("Café", "cafe"),
    ("a\nb", "ab"),
    ("a  b", "a b"),
    ("a..b--c!!", "a.b-c!!"),
    ("x`y^z", "xyz"),
    ("ᴥ", "ain"),
    ("👈 go", ":point_left: go"),
    ("▶️", ":arrow_forward:"),
    ("ﬁn ½", "fin 1⁄2"),
    ("", ""),
])
def test_normalise_cases(spark, given, expected):
    assert run(spark, [given], text.normalise) == [expected]


def test_normalise_equals_character_walk(spark):
    """The JVM path and the UDF path agree with a plain walk over the characters."""
    rng = random.Random(7)
    pools = [
        [chr(c) for c in range(32, 127)], [chr(c) for c in range(0xA0, 0x250)], list(fold_map()),
        [chr(c) for c in range(0x370, 0x530)], list(text.BUFFER_CHARS), [chr(c) for c in range(0x1D400, 0x1D800)],
        list("👈👉☝🎁▶⬆😀ﬁ½①カ漢한"), [chr(c) for c in range(0x2000, 0x20C0)], [" ", "\t", "\n", "\u00a0"],
    ]  # U+20C0 is newer than the Unicode tables of Java 17, which call it unassigned
    assigned = lambda c: unicodedata.category(c) != "Cn"
    values = []
    for _ in range(400):
        pool = rng.choice(pools) + pools[0][:30]
        values.append("".join(c for c in rng.choices(pool, k=rng.randrange(1, 30)) if assigned(c)))
    got = run(spark, values, text.normalise)
    want = [plain_normalise(v) for v in values]
    assert [(v, g, w) for v, g, w in zip(values, got, want) if g != w] == []


def test_order_of_whitespace_and_strip(spark):
    assert run(spark, ["a\nb"], text.surface_text) == ["a b"]
    assert run(spark, ["a\nb"], text.normalise) == ["ab"]


def test_browser_profile(spark):
    assert run(spark, ["  A..B\t\tC  ", "a\tb", "👍🏽"], text.normalise_browser) == ["a..b c", "a\tb", ":thumbs_up_sign:"]


def test_fold_is_case_sensitive_and_complete(spark):
    assert run(spark, ["ᴛᴇʟᴇ н Н ʣ ǝ"], text.fold_lookalikes) == ["TELE H Н dz ǝ"]
    assert len(fold_map()) == 202


def test_pair_text(spark):
    rows = spark.createDataFrame([("Bob", "HI")], "a string, t string")
    assert rows.select(text.pair_text(F.col("a"), F.col("t"))).first()[0] == "bob commented hi"


def test_live_profile_keeps_marks_that_are_no_diacritics(spark):
    """A letter gives the same result whatever else is in the text."""
    letters = [chr(c) for c in (*range(0x622, 0x627), 0x6C0, 0x6C2, 0x6D3, 0xE33, 0xEB3, 0x1026)]
    want = [regex.sub(r"\p{Diacritic}", "", unicodedata.normalize("NFKD", c)) for c in letters]
    assert run(spark, letters, text.normalise_browser) == want
    mixed = [f"{c} \u261d" for c in letters]
    assert [r.split(" ")[0] for r in run(spark, mixed, text.normalise_browser)] == want


@pytest.mark.parametrize("live", [False, True])
def test_characters_that_become_several_are_found_behind_the_wide_ranges(spark, live):
    single, several, pattern = text._tables(live)
    assert set(several) <= {c for c in several if regex.match(f"[{java_ranges(text._covering(map(ord, several)))}]", c)}
    # letters of European languages never reach the long classes
    wide = java_ranges(text._covering(map(ord, several)))
    assert not regex.search(f"[{wide}]", "plain äöüéèçñ text, 0-9")
    rows = spark.createDataFrame([(c,) for c in several], "c string")
    assert rows.where(~F.col("c").rlike(pattern)).count() == 0
    assert spark.createDataFrame([(c,) for c in ("a", "7", "é", "ñ")], "c string").where(F.col("c").rlike(pattern)).count() == 0
    assert "(?=" in pattern


def java_ranges(content):
    """A Java class content in the spelling of ``regex``."""
    return regex.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\U{int(m[1], 16):08X}", content)
