"""SQL spellings of the text rules for the DuckDB oracle.

They cover the characters that occur in the test tables and the planted rows.
"""

from __future__ import annotations

from commentlens.functions import lookalikes, rulebook, tokens, urls
from commentlens.operators.cascade import RULES
from commentlens.plans.views import SEEDED_SQL

STRIP = r"[\p{Mn}\p{Cc}\p{Cf}\p{Co}\p{Sk}]"
BUFFER = "*_~|`[]()'-.•,"


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def collapse(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def collapse_long(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '^\s+|\s+$', '', 'g'), '\s\s+', ' ', 'g')"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '{STRIP}', '', 'g')"


def buffer_runs(x: str) -> str:
    for char in BUFFER:
        x = f"regexp_replace({x}, {q('[' + (chr(92) + char if char in '[]*-|' else char) + ']+')}, {q(char)}, 'g')"
    return x


def decompose(x: str) -> str:
    for char, alias in (("☝", "point_up"), ("👉", "point_right"), ("▶", "arrow_forward"), ("🎁", "gift"),
                        ("➕", "heavy_plus_sign")):
        x = f"replace({x}, '{char}', ':{alias}:')"
    return f"strip_accents(translate({x}, '①②③④⑤⑥𝐟𝐫𝐞𝐕𝐁𝐔𝐂𝐊𝐒', '123456freVBUCKS'))"


def fold(x: str) -> str:
    return f"translate({x}, 'ᴛᴇʟ', 'TEL')"


def normal(x: str) -> str:
    return f"lower({buffer_runs(collapse(strip(fold(decompose(x)))))})"


def normal_live(x: str) -> str:
    return f"lower({collapse_long('regexp_replace(' + fold(decompose(x)) + r", '[\p{Mn}`^]', '', 'g')")})"


def surface_author(x: str) -> str:
    return strip(collapse(x))


def surface_text(x: str) -> str:
    return strip(buffer_runs(collapse(x)))


def _glyphs(letter: str) -> str:
    known = sorted(g for g in lookalikes.spelling().glyphs[letter] if g <= "ӿ")
    return "[" + "".join(rf"\x{{{ord(g):X}}}" for g in known) + "]"


def phrase_test(x: str, phrases) -> str:
    joiner = r"[*_~|`\[\]()'\-.•,\p{Mn}]*"
    tests = []
    for phrase in phrases:
        whole = phrase.startswith(r"\b")
        letters = phrase.replace(r"\b", "")
        if max(letters) > "ӿ":
            tests.append(f"contains({x}, {q(letters)})")
            continue
        body = joiner.join(_glyphs(c) for c in letters)
        tests.append(f"regexp_matches({x}, {q(rf'\b{joiner}{body}{joiner}\b' if whole else body)})")
    return "(" + " OR ".join(tests or ["false"]) + ")"


def item_test(x: str, item: str) -> str:
    if item.startswith("re:"):
        return f"regexp_matches({x}, {q(item[3:])})"
    if item.startswith("~"):
        return f"NOT contains({x}, {q(item[1:])})"
    return f"contains({x}, {q(item)})"


def combo_test(x: str, items) -> str:
    return "(" + " AND ".join(item_test(x, i) for i in items) + ")"


def any_combo(x: str, combos) -> str:
    return "(" + " OR ".join([combo_test(x, c) for c in combos] or ["false"]) + ")"


def any_pair(a: str, t: str, combos) -> str:
    return "(" + " OR ".join(f"({combo_test(a, x)} AND {combo_test(t, y)})" for x, y in combos) + ")"


def styled_count(x: str) -> str:
    return f"len(regexp_extract_all({x}, '[{rulebook.STYLED_DIGITS}]'))"


PHONE = q(rulebook.PHONE_PREFIX)
URL = q(urls.url_pattern(java=False))


def host_case(x: str) -> str:
    url = f"regexp_extract({x}, {URL}, 0)"
    whens = " ".join(
        f"WHEN regexp_matches({url}, {q(p)}) THEN {q(n)}" for n, p in urls.host_patterns(java=False).items()
    )
    return f"CASE {whens} END"


# a, t: surface forms; na, nt: normalised
SURFACE_SQL = SEEDED_SQL + f"""
, surface AS (SELECT *, {surface_author('author_name')} AS a, {surface_text('text')} AS t FROM seeded)
, normal AS (SELECT *, {normal('a')} AS na, {normal('t')} AS nt FROM surface)
"""

LIVE_SURFACE_SQL = SEEDED_SQL + f"""
, surface AS (SELECT *, {collapse_long('author_name')} AS a, {collapse_long('text')} AS t FROM seeded)
, normal AS (SELECT *, {normal_live('a')} AS na, {normal_live('t')} AS nt FROM surface)
"""


def _flagged(book: rulebook.RuleBook, live: bool) -> str:
    if live:
        first_link = "list_extract(regexp_extract_all(html, '<a\\b[^>]*?\\bhref=\"([^\"]+)\"', 1), 1)"
        only = r"regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.\-]*:')"
        linked = (f"({first_link} IS NOT NULL AND NOT "
                  rf"regexp_matches({first_link}, '/watch\?v=[0-9A-Za-z_-]{{11}}&amp;t=\d+'))")
    else:
        only = f"(t <> '' AND regexp_extract(t, {URL}, 0) = t)"
        linked = f"regexp_matches(t, {URL})"
    tests = {
        "author_scam": phrase_test("a", book.author_scam),
        "author_no_video": phrase_test("a", book.author_no_video),
        "author_ad": phrase_test("a", book.author_ad),
        "author_combo": any_combo("na", book.author_combos),
        "text_scam": phrase_test("t", book.text_scam),
        "text_filled": f"regexp_matches(nt, {q('|'.join(book.text_filled))})" if book.text_filled else "false",
        "text_combo": any_combo("nt", book.text_combos),
        "pair_combo": any_pair("na", "nt", book.pair_combos),
        "known_spam": any_combo("nt", book.known_spam),
        "styled_digits": f"{styled_count('a || chr(32) || t')} >= {rulebook.STYLED_DIGIT_MINIMUM}",
        "disguised_phone": f"regexp_matches(a || ' ' || t, {PHONE})",
        "link_spam": f"(regexp_matches(nt, {q(book.video_link)}) AND {any_combo('nt', book.link_combos)})",
        "link_only": only,
        "link_contains": linked,
    }
    whens = " ".join(f"WHEN {tests[name]} THEN {i}" for i, name, _ in RULES[:-1])
    labels = "[" + ", ".join(q(label) for _, _, label in RULES) + "]"
    return f"""
, hits AS (SELECT *, CAST(CASE {whens} ELSE {RULES[-1][0]} END AS bigint) AS rule_id FROM normal)
, flagged AS (SELECT *, {labels}[rule_id] AS rule_label FROM hits)
"""


def flagged_sql(book: rulebook.RuleBook) -> str:
    """The cascade with other lists."""
    return SURFACE_SQL + _flagged(book, live=False)


FLAGGED_SQL = SURFACE_SQL + _flagged(rulebook.RuleBook(), live=False)
LIVE_FLAGGED_SQL = LIVE_SURFACE_SQL + _flagged(rulebook.RuleBook.live(), live=True)


def tokens_of(x: str) -> str:
    return rf"regexp_extract_all({x}, '\b\w+\b|[^\s\w]')"


# comment tokens, their counts, a vocabulary of the benchmark's pieces, greedy subwords
TOKENS_SQL = SEEDED_SQL + f"""
, plain AS (SELECT comment_id, {normal('text')} AS text FROM seeded)
, occurrences AS (SELECT comment_id, {tokens_of('text')} AS toks FROM plain)
, counts AS (SELECT token, count(*) AS n FROM (SELECT unnest(toks) AS token FROM occurrences) GROUP BY token)
, pieces AS (
    SELECT DISTINCT unnest(CASE WHEN length(token) >= 4 THEN [token, substr(token, 1, 3),
        '##' || right(token, 2), '##' || right(token, 1)] ELSE [token] END) AS piece
    FROM (SELECT DISTINCT unnest({tokens_of(normal('text'))}) AS token FROM benchmark))
, vocabulary AS (SELECT piece, 999 + row_number() OVER (ORDER BY piece) AS id FROM pieces)
"""

SUBWORDS_SQL = TOKENS_SQL.replace("WITH ", "") + f"""
, walk AS (
    SELECT token, 1 AS next, [] :: varchar[] AS pieces, [] :: bigint[] AS ids FROM counts
    UNION ALL
    SELECT token, next + size, list_append(pieces, piece), list_append(ids, id) FROM (
        SELECT w.token, w.next, w.pieces, w.ids, v.piece, v.id,
               length(v.piece) - CASE WHEN w.next > 1 THEN 2 ELSE 0 END AS size,
               row_number() OVER (PARTITION BY w.token ORDER BY length(v.piece) DESC) AS best
        FROM walk w, range(1, 40) r(k), vocabulary v
        WHERE r.k <= length(w.token) - w.next + 1
          AND v.piece = CASE WHEN w.next > 1 THEN '##' ELSE '' END || substr(w.token, w.next, r.k))
    WHERE best = 1)
, subwords AS (
    SELECT c.token, coalesce(w.pieces, ['{tokens.UNKNOWN}']) AS pieces, coalesce(w.ids, [100]) AS ids
    FROM counts c LEFT JOIN walk w ON w.token = c.token AND w.next = length(c.token) + 1)
"""
