"""Queries for text functions, rules, tokens and page markup."""

from __future__ import annotations

from pyspark.sql import functions as F

from commentlens.functions import html, matching, rulebook, text, tokens, urls
from commentlens.functions.lookalikes import spelling
from commentlens.operators import cascade, wordpieces
from commentlens.functions.rulebook import RuleBook
from commentlens.operators.dataset import label_counts
from commentlens.operators.mapping import map_batches
from commentlens.operators.store import update_by_key
from commentlens.plans import oracle as o
from commentlens.plans import views
from commentlens.plans.registry import query, table
from commentlens.schema import LABELS
from commentlens.session import written_table


# --- normalisation ---------------------------------------------------------------------------


@query("text_surface", f"""
    WITH {views.SEEDED_SQL}
    SELECT comment_id, md5({o.collapse('text')}) AS collapsed, md5({o.strip('text')}) AS stripped,
           md5({o.buffer_runs('text')}) AS runs, {o.surface_author('author_name')} AS author,
           md5({o.surface_text('text')}) AS surface
    FROM seeded""")
def text_surface(spark, folder):
    t = F.col("text")
    return views.comments_seeded(spark, folder).select(
        "comment_id",
        F.md5(text.collapse_whitespace(t)).alias("collapsed"),
        F.md5(text.strip_categories(t)).alias("stripped"),
        F.md5(text.collapse_buffer_runs(t)).alias("runs"),
        text.surface_form(F.col("author_name")).alias("author"),
        F.md5(text.surface_text(t)).alias("surface"),
    )


@query("fold_lookalikes", f"""
    WITH {views.SEEDED_SQL}
    SELECT comment_id, {o.fold('author_name')} AS author, md5({o.fold('text')}) AS text FROM seeded""")
def fold_lookalikes(spark, folder):
    return views.comments_seeded(spark, folder).select(
        "comment_id",
        text.fold_lookalikes(F.col("author_name")).alias("author"),
        F.md5(text.fold_lookalikes(F.col("text"))).alias("text"),
    )


@query("normalise_text", f"""
    WITH {views.SEEDED_SQL}
    SELECT comment_id, {o.normal('author_name')} AS author, md5({o.normal('text')}) AS text FROM seeded""")
def normalise_text(spark, folder):
    return views.comments_seeded(spark, folder).select(
        "comment_id",
        text.normalise(F.col("author_name")).alias("author"),
        F.md5(text.normalise(F.col("text"))).alias("text"),
    )


@query("normalise_live", f"""
    WITH {views.SEEDED_SQL}
    SELECT comment_id, {o.normal_live('author_name')} AS author, md5({o.normal_live('text')}) AS text FROM seeded""")
def normalise_live(spark, folder):
    return views.comments_seeded(spark, folder).select(
        "comment_id",
        text.normalise_browser(F.col("author_name")).alias("author"),
        F.md5(text.normalise_browser(F.col("text"))).alias("text"),
    )


@query("pair_text", f"""
    WITH {views.SEEDED_SQL}
    SELECT comment_id, md5({o.normal('author_name')} || ' commented ' || {o.normal('text')}) AS pair FROM seeded""")
def pair_text(spark, folder):
    pair = text.pair_text(F.col("author_name"), F.col("text"))
    return views.comments_seeded(spark, folder).select("comment_id", F.md5(pair).alias("pair"))


# --- single rules ----------------------------------------------------------------------------


@query("letter_phrases", f"""
    WITH {o.SURFACE_SQL}
    SELECT comment_id, {o.phrase_test('a', rulebook.AUTHOR_SCAM_PHRASES)} AS scam,
           {o.phrase_test('a', rulebook.AUTHOR_NO_VIDEO_PHRASES)} AS no_video,
           {o.phrase_test('a', rulebook.AUTHOR_AD_PHRASES)} AS ad,
           {o.phrase_test('t', rulebook.TEXT_SCAM_PHRASES)} AS text_scam,
           regexp_matches(nt, {o.q('|'.join(rulebook.TEXT_FILLED_PHRASES))}) AS filled
    FROM normal""")
def letter_phrases(spark, folder):
    glyphs = spelling()
    rows = views.comments_seeded(spark, folder).select(
        "comment_id",
        text.surface_form(F.col("author_name")).alias("a"),
        text.surface_text(F.col("text")).alias("t"),
    ).select("comment_id", glyphs.canonical(F.col("a")).alias("a"), glyphs.canonical(F.col("t")).alias("ct"),
             text.normalise(F.col("t")).alias("nt"))
    return rows.select(
        "comment_id",
        F.col("a").rlike(glyphs.pattern(rulebook.AUTHOR_SCAM_PHRASES)).alias("scam"),
        F.col("a").rlike(glyphs.pattern(rulebook.AUTHOR_NO_VIDEO_PHRASES)).alias("no_video"),
        F.col("a").rlike(glyphs.pattern(rulebook.AUTHOR_AD_PHRASES)).alias("ad"),
        F.col("ct").rlike(glyphs.pattern(rulebook.TEXT_SCAM_PHRASES)).alias("text_scam"),
        matching.filled_phrases(F.col("nt"), rulebook.TEXT_FILLED_PHRASES).alias("filled"),
    )


@query("combo_hits", f"""
    WITH {o.SURFACE_SQL}
    SELECT comment_id, {o.any_combo('na', rulebook.AUTHOR_COMBOS)} AS author,
           {o.any_combo('nt', rulebook.TEXT_SCAM_COMBOS)} AS scam,
           {o.any_pair('na', 'nt', rulebook.PAIR_COMBOS)} AS pair,
           {o.any_combo('nt', rulebook.KNOWN_SPAM_COMBOS)} AS known,
           {o.any_combo('nt', rulebook.LINK_COMBOS)} AS link,
           {o.any_combo('nt', [('trash',), ('house',), ('http',)])} AS listed
    FROM normal""")
def combo_hits(spark, folder):
    rows = views.comments_seeded(spark, folder).select(
        "comment_id",
        text.surface_form(F.col("author_name")).alias("a"),
        text.surface_text(F.col("text")).alias("t"),
    ).select("comment_id", text.normalise(F.col("a")).alias("na"), text.normalise(F.col("t")).alias("nt"))
    na, nt = F.col("na"), F.col("nt")
    return rows.select(
        "comment_id",
        matching.any_combo(na, rulebook.AUTHOR_COMBOS).alias("author"),
        matching.any_combo(nt, rulebook.TEXT_SCAM_COMBOS).alias("scam"),
        matching.any_pair_combo(na, nt, rulebook.PAIR_COMBOS).alias("pair"),
        matching.any_combo(nt, rulebook.KNOWN_SPAM_COMBOS).alias("known"),
        matching.any_combo(nt, rulebook.LINK_COMBOS).alias("link"),
        matching.contains_any(nt, ["trash", "house", "http"]).alias("listed"),
    )


@query("styled_digits", f"""
    WITH {views.SEEDED_SQL}
    SELECT comment_id, CAST({o.styled_count('text')} AS bigint) AS n, {o.styled_count('text')} >= 6 AS hit
    FROM seeded""")
def styled_digits(spark, folder):
    n = matching.styled_digit_count(F.col("text"))
    return views.comments_seeded(spark, folder).select(
        "comment_id", n.cast("bigint").alias("n"), matching.has_styled_digits(F.col("text")).alias("hit")
    )


@query("phone_prefix", f"""
    WITH {views.SEEDED_SQL}
    SELECT comment_id, regexp_matches(text, {o.PHONE}) AS hit FROM seeded""")
def phone_prefix(spark, folder):
    return views.comments_seeded(spark, folder).select(
        "comment_id", matching.has_disguised_phone(F.col("text")).alias("hit")
    )


@query("url_classify", f"""
    WITH {views.SEEDED_SQL}, texts AS (
        SELECT 'c' || comment_id AS id, {o.surface_text('text')} AS t FROM seeded
        UNION ALL SELECT 'p' || page_id, url FROM pages)
    SELECT id, regexp_matches(t, {o.URL}) AS has_url, t <> '' AND regexp_extract(t, {o.URL}, 0) = t AS only_url,
           {o.host_case('t')} AS host
    FROM texts""")
def url_classify(spark, folder):
    texts = views.comments_seeded(spark, folder).select(
        F.concat(F.lit("c"), "comment_id").alias("id"), text.surface_text(F.col("text")).alias("t")
    ).unionByName(
        views.links(spark, folder).select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id"),
                                          F.col("url").alias("t"))
    )
    t = F.col("t")
    return texts.select("id", urls.contains_url(t).alias("has_url"), urls.is_only_url(t).alias("only_url"),
                        urls.host_class(t).alias("host"))


@query("absolute_url", r"""
    SELECT page_id, regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.\-]*:') AS absolute,
           regexp_matches(html, '^[A-Za-z][A-Za-z0-9+.\-]*:') AS markup
    FROM pages""")
def absolute_url(spark, folder):
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    return pages.select("page_id", urls.is_absolute_url(F.col("url")).alias("absolute"),
                        urls.is_absolute_url(F.col("html")).alias("markup"))


# --- cascade ---------------------------------------------------------------------------------


@query("rule_flag", f"WITH {o.FLAGGED_SQL} SELECT comment_id, rule_id, rule_label FROM flagged")
def rule_flag(spark, folder):
    flagged = cascade.flag(views.comments_seeded(spark, folder))
    return flagged.select("comment_id", "rule_id", "rule_label")


_ALL_LABELS = ", ".join(f"('{name}')" for name in LABELS)


@query("rule_label_counts", f"""
    WITH {o.FLAGGED_SQL}
    SELECT label, count(comment_id) AS n
    FROM (VALUES {_ALL_LABELS}) names(label) LEFT JOIN flagged ON rule_label = names.label GROUP BY names.label
    """.replace("SELECT label,", "SELECT names.label AS label,"))
def rule_label_counts(spark, folder):
    return label_counts(cascade.flag(views.comments_seeded(spark, folder)), "rule_label")


@query("rule_hits_by_rule", f"WITH {o.FLAGGED_SQL} SELECT rule_id, count(*) AS n FROM flagged GROUP BY rule_id")
def rule_hits_by_rule(spark, folder):
    flagged = cascade.flag(views.comments_seeded(spark, folder))
    return flagged.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))


@query("rule_drop_valid", f"""
    WITH {o.FLAGGED_SQL}
    SELECT comment_id, rule_label FROM flagged WHERE rule_label <> 'VALID'""")
def rule_drop_valid(spark, folder):
    flagged = cascade.flag(views.comments_seeded(spark, folder)).filter(F.col("rule_label") != "VALID")
    return flagged.select("comment_id", "rule_label")


@query("rule_relabel", f"""
    WITH {o.FLAGGED_SQL}
    SELECT comment_id, CASE WHEN NOT moderated AND label = 'SCAM' THEN rule_label ELSE label END AS label, moderated
    FROM flagged""")
def rule_relabel(spark, folder):
    stored = views.comments_seeded(spark, folder)
    recheck = stored.filter(~F.col("moderated") & (F.col("label") == "SCAM"))
    relabelled = cascade.relabel(recheck).select("comment_id", "label")
    return update_by_key(stored, relabelled).select("comment_id", "label", "moderated")


@query("live_rule_flag", f"WITH {o.LIVE_FLAGGED_SQL} SELECT comment_id, rule_id, rule_label FROM flagged")
def live_rule_flag(spark, folder):
    flagged = cascade.flag(views.comments_seeded(spark, folder), live=True, html="html")
    return flagged.select("comment_id", "rule_id", "rule_label")


# --- tokens ----------------------------------------------------------------------------------


def _plain(spark, folder):
    return views.comments_seeded(spark, folder).select("comment_id", text.normalise(F.col("text")).alias("text"))


def _vocabulary(spark, folder):
    """The words of ``benchmark`` as the given vocabulary, with starts and continuations of the longer ones."""
    token = F.col("token")
    words = table(spark, folder, "benchmark").select(F.explode(tokens.pretokenise(text.normalise(F.col("text")))).alias("token"))
    pieces = F.array(
        token, F.substring(token, 1, 3), F.concat(F.lit("##"), F.right(token, F.lit(2))), F.concat(F.lit("##"), F.right(token, F.lit(1))))
    pieces = words.distinct().select(F.explode(F.when(F.length(token) >= 4, pieces).otherwise(F.array(token))).alias("piece"))
    return written_table(wordpieces.numbered_pieces(pieces), "vocabulary")


@query("pretokenise", f"""
    WITH {o.TOKENS_SQL}
    SELECT comment_id, CAST(len(toks) AS bigint) AS n, md5(array_to_string(toks, ' ')) AS tokens FROM occurrences""")
def pretokenise(spark, folder):
    rows = _plain(spark, folder).select("comment_id", tokens.pretokenise(F.col("text")).alias("tokens"))
    return rows.select("comment_id", F.size("tokens").cast("bigint").alias("n"),
                       F.md5(F.array_join("tokens", " ")).alias("tokens"))


@query("token_counts", f"WITH {o.TOKENS_SQL} SELECT token, n FROM counts")
def token_counts(spark, folder):
    return wordpieces.token_counts(_plain(spark, folder))


@query("vocabulary_ids", f"""
    WITH {o.TOKENS_SQL}
    SELECT token, n, coalesce(id, -1) AS id FROM counts LEFT JOIN vocabulary ON piece = token""")
def vocabulary_ids(spark, folder):
    found = wordpieces.lookup_ids(wordpieces.token_counts(_plain(spark, folder)), _vocabulary(spark, folder))
    return found.select("token", "n", F.coalesce("id", F.lit(-1)).alias("id"))


@query("subword_pieces", f"""
    WITH RECURSIVE {o.SUBWORDS_SQL}
    SELECT token, array_to_string(pieces, ' ') AS pieces, array_to_string(ids, ' ') AS ids FROM subwords""")
def subword_pieces(spark, folder):
    counts = written_table(wordpieces.token_counts(_plain(spark, folder)), "token-counts")
    split = wordpieces.split_tokens(counts, _vocabulary(spark, folder))
    return split.select("token", F.array_join("pieces", " ").alias("pieces"),
                        F.array_join(F.transform("ids", lambda i: i.cast("string")), " ").alias("ids"))


_ENCODED_SQL = o.SUBWORDS_SQL + """
, heads AS (SELECT comment_id, unnest(toks) AS token, generate_subscripts(toks, 1) AS pos FROM occurrences)
, encoded AS (
    SELECT comment_id, flatten(list(ids ORDER BY pos)) AS ids FROM heads JOIN subwords USING (token) GROUP BY comment_id)
, padded AS (SELECT p.comment_id, coalesce(e.ids, []) AS ids FROM plain p LEFT JOIN encoded e USING (comment_id))
"""


@query("pad_truncate", f"""
    WITH RECURSIVE {_ENCODED_SQL}
    SELECT comment_id, array_to_string(list_resize([101] || ids[1:126] || [102], 128, 0), ' ') AS ids FROM padded""")
def pad_truncate(spark, folder):
    plain = _plain(spark, folder)
    encoded = wordpieces.encode(plain, _vocabulary(spark, folder), "comment_id", length=tokens.SEQUENCE_LENGTH - 2)
    padded = tokens.fixed_length(F.col("ids"))
    return encoded.select("comment_id", F.array_join(F.transform(padded, lambda i: i.cast("string")), " ").alias("ids"))


@query("model_inputs", f"""
    WITH RECURSIVE {_ENCODED_SQL}
    SELECT comment_id, '101 ' || CASE WHEN len(ids) > 0 THEN array_to_string(ids, ' ') || ' ' ELSE '' END || '102'
               AS input_ids, CAST(len(ids) + 2 AS bigint) AS attended FROM padded""")
def model_inputs(spark, folder):
    plain = _plain(spark, folder)
    encoded = wordpieces.encode(plain, _vocabulary(spark, folder), "comment_id")
    ids = tokens.with_markers(F.col("ids"))
    attended = F.aggregate(tokens.attention_mask(ids), F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    return encoded.select(
        "comment_id",
        F.array_join(F.transform(ids, lambda i: i.cast("string")), " ").alias("input_ids"),
        attended.alias("attended"),
    )


# --- page markup and links -------------------------------------------------------------------


@query("page_visible_text", rf"""
    WITH {views.LINKS_SQL}
    SELECT page_id, md5(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html,
        '(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>', '', 'g'),
        '(?is)<img\b[^>]*?\balt="([^"]*)"[^>]*>', '\1', 'g'), '(?s)<[^>]+>', '', 'g'),
        '&middot;', '·'), '&copy;', '©'), '&quot;', '"'), '&amp;', '&')) AS text
    FROM links""")
def page_visible_text(spark, folder):
    return views.links(spark, folder).select("page_id", F.md5(html.visible_text(F.col("html"))).alias("text"))


@query("clickable_links", rf"""
    WITH {views.LINKS_SQL}, found AS (
        SELECT page_id, regexp_extract_all(html, '(?i)<a\b[^>]*?\bhref="([^"]+)"', 1) AS targets FROM links)
    SELECT page_id, CAST(len(targets) AS bigint) AS n, coalesce(len(targets) > 0 AND
        NOT regexp_matches(targets[1], '/watch\?v=[0-9A-Za-z_-]{{11}}&amp;t=\d+'), false) AS clickable
    FROM found""")
def clickable_links(spark, folder):
    markup = F.col("html")
    return views.links(spark, folder).select(
        "page_id", F.size(html.link_targets(markup)).cast("bigint").alias("n"),
        html.has_clickable_link(markup).alias("clickable"),
    )


@query("body_links", """
    SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'http://a.example.com/?x=1&y=2' WHEN 1 THEN 'http://b.example.com/' END AS target,
           page_id % 4 < 2 AS clickable, 'a > b "q" ' || page_id || ' é ☺ &amp;' AS shown FROM pages""")
def body_links(spark, folder):
    """Anchors of the comment body among others, and text with references and any quoting, put around the page ids."""
    number = F.col("page_id").cast("string")
    other = F.lit("<a data-href='http://no.example.com' href=http://other.example.com class='x yt-simple'>o</a>")
    body = (
        F.when(F.col("page_id") % 4 == 0, F.concat(other, F.lit("<a class='big yt-simple-endpoint' title='>' href='http://a.example.com/?x=1&#38;y=2'>")))
        .when(F.col("page_id") % 4 == 1, F.lit('<A HREF=http://b.example.com/ CLASS=yt-simple-endpoint>'))
        .when(F.col("page_id") % 4 == 2, F.lit('<a class="yt-simple-endpoint" href="/watch?v=abcdefghijk&amp;t=10">')).otherwise(other)
    )
    shown = F.concat(F.lit("<p title='1 > 0'>a &gt; b <img data-alt='no' alt='&quot;q&quot;' src=x> "), number, F.lit(" &eacute; &#x263A; &amp;amp;</p>"))
    rows = table(spark, folder, "pages").select("page_id", body.alias("body"), shown.alias("shown"))
    first = F.try_element_at(html.link_targets(F.col("body"), html.BODY_LINK_CLASS), F.lit(1))
    return rows.select("page_id", F.when(F.col("page_id") % 4 < 2, first).alias("target"),
                       html.has_clickable_link(F.col("body"), html.BODY_LINK_CLASS).alias("clickable"), html.visible_text(F.col("shown")).alias("shown"))


@query("batched_map", f"""
    WITH {views.COMMENTS_SQL}
    SELECT comment_id, author_name || ' commented ' || text AS pair, length(author_name || ' commented ' || text) AS letters,
           CASE label WHEN 'VALID' THEN 0 WHEN 'SCAM' THEN 1 WHEN 'OTHER_SPAM' THEN 9 ELSE -1 END AS label FROM comments""")
def batched_map(spark, folder):
    """A user function on column batches: model input, its length, and the label as a number."""
    numbers = {name: i for i, name in enumerate(LABELS)}

    def prepare(columns):
        pairs = [f"{a} commented {t}" for a, t in zip(columns["author_name"].to_pylist(), columns["text"].to_pylist(), strict=True)]
        return {"pair": pairs, "letters": [len(p) for p in pairs], "label": [numbers.get(x, -1) for x in columns["label"].to_pylist()]}

    rows = views.comments(spark, folder).select("comment_id", "author_name", "text", "label")
    return map_batches(rows, prepare, "pair string, letters bigint, label bigint", ["author_name", "text", "label"]).drop("author_name", "text")


_OWN_LISTS = {"author_scam": ["user 3"], "author_no_video": [], "author_ad": [], "text_scam": [], "text_filled": [], "author_combos": [["user", "1", "~user 11"]],
              "text_combos": [["tion", "the ", "~and "]], "pair_combos": [[["user 5"], ["on"]]], "known_spam": [["re:^[a-m]"]], "link_combos": []}


@query("own_rules", f"""
    WITH {o.flagged_sql(RuleBook.from_lists(_OWN_LISTS))}
    SELECT comment_id, rule_id, rule_label FROM flagged""")
def own_rules(spark, folder):
    """The cascade with a caller's rule lists."""
    flagged = cascade.flag(views.comments_seeded(spark, folder), book=RuleBook.from_lists(_OWN_LISTS))
    return flagged.select("comment_id", "rule_id", "rule_label")


@query("url_query_param", r"""
    SELECT page_id, nullif(regexp_extract(url, '[?&]ref=([^&#]*)', 1), '') AS ref, 'c' || page_id AS lc FROM pages""")
def url_query_param(spark, folder):
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    bare = F.regexp_extract(F.col("url"), r"^[^?#]*", 0)
    tagged = F.concat(bare, F.lit("?a=b&lc=c"), F.col("page_id").cast("string"))
    return pages.select("page_id", html.query_parameter(F.col("url"), "ref").alias("ref"),
                        html.query_parameter(tagged, "lc").alias("lc"))


@query("channel_id", """
    WITH """ + views.COMMENTS_SQL + """
    SELECT comment_id, author_channel_id AS channel,
           'https://www.youtube.com/watch?v=' || video_id || '&lc=' || comment_id AS url FROM comments""")
def channel_id(spark, folder):
    profile = F.concat(F.lit(html.CHANNEL_PREFIX), F.col("author_channel_id"))
    return views.comments(spark, folder).select(
        "comment_id", html.channel_id(profile).alias("channel"),
        html.permalink(F.col("video_id"), F.col("comment_id")).alias("url"),
    )
