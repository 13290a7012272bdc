"""The registered queries of this folder and their DuckDB oracles."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commentlens.llm import bytecnn
from commentlens.llm.blocknames import exact_duplicates
from commentlens.llm.circulant import near_duplicates
from commentlens.llm.contain import contaminated
from commentlens.llm.linetemplates import drop_recurring_lines
from commentlens.llm.mixing import mixed
from commentlens.llm.phrases import collocations
from commentlens.llm.secrets import find_secrets
from commentlens.llm.superkmers import drop_repeats
from commentlens.llm.tokenalign import alignments
from commentlens.llm.tokencount import token_counts
from commentlens.llm.urlcascade import SITES, url_verdicts
from commentlens.llm.warc import archived
from commentlens.plans.registry import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register under ``name``; these stay apart from the other queries, which need none of them."""

    def register(function):
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return register


@query("op1_exact_dedup", r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS s FROM documents),
g AS (SELECT s, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY s)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, t.s AS text_sha256 FROM t JOIN g ON t.s = g.s""")
def op1_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_duplicates(table(spark, folder, "documents"))


@query("op4_substring_dedup", r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(ws) - 48)) AS i, ws FROM w WHERE len(ws) >= 50),
v AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h FROM p),
m AS (SELECT h, min(doc_id) AS least FROM v GROUP BY h),
f AS (SELECT DISTINCT v.doc_id, unnest(range(i, i + 50)) AS pos FROM v JOIN m USING (h) WHERE v.doc_id > least),
x AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS pos, unnest(ws) AS word FROM w),
k AS (SELECT x.doc_id, count(f.pos) AS n_removed, string_agg(word, ' ' ORDER BY x.pos) FILTER (f.pos IS NULL) AS kept
      FROM x LEFT JOIN f ON f.doc_id = x.doc_id AND f.pos = x.pos GROUP BY x.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)""")
def op4_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return drop_repeats(table(spark, folder, "documents"))


@query("op8_minhash_near_dedup", r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(ws[i:i + 3], ' ')) AS h FROM p),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
j AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM j JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
r(doc_id, reach) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reach)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(reach) AS component_id, d.doc_id = min(reach) AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN r USING (doc_id) GROUP BY d.doc_id, n""")
def op8_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"), shingle=4).drop("class_size")


@query("op10_quality_classifier")
def op10_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    network = bytecnn.train(docs, labels)
    return bytecnn.scored(docs.select("doc_id", "text"), network).select(
        "doc_id", bytecnn.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query("op2_source_mixing")
def op2_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    return mixed(docs, labels, keep=["doc_id"])


@query("op6_url_filter", rf"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
s AS (SELECT page_id, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT *, CASE
        WHEN ('.' || host) LIKE '%.www.example.com' AND path LIKE '/en/%' THEN 'www.example.com/en/'
        WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/en/%' THEN 'example.com/en/'
        WHEN ('.' || host) LIKE '%.net' AND path LIKE '/es/%' THEN 'net/es/'
        WHEN ('.' || host) LIKE '%.net' AND path LIKE '/fr/%' THEN 'net/fr/'
        WHEN ('.' || host) LIKE '%.com' AND path LIKE '/%' THEN 'com/' END AS rule,
        len(list_intersect(string_split(host, '.'), {list(SITES)})) > 0 AS listed FROM s)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block'
    WHEN rule IS NULL AND listed THEN 'block' ELSE 'allow' END AS verdict, listed FROM r""")
def op6_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_verdicts(table(spark, folder, "pages"))


@query("op7_line_dedup")
def op7_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return drop_recurring_lines(table(spark, folder, "documents"))


@query("op9_benchmark_decontamination", r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
      FROM documents WHERE doc_id IS NOT NULL),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
      FROM benchmark WHERE item_id IS NOT NULL),
d AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
q AS (SELECT DISTINCT item_id, array_to_string(ws[i:i + 4], ' ') AS s FROM (SELECT item_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM b WHERE len(ws) >= 5)),
n AS (SELECT item_id, count(*) AS n_item FROM q GROUP BY item_id),
f AS (SELECT doc_id, item_id, count(*) AS n_found FROM d JOIN q ON d.s = q.s GROUP BY ALL)
SELECT doc_id, item_id, n_item, n_found, n_found / n_item AS containment FROM f JOIN n USING (item_id) WHERE n_found * 100 >= n_item * 80""")
def op9_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op3_warc", r"""
WITH t AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
g AS (SELECT body, max(page_id) AS last FROM t GROUP BY body),
b AS (SELECT page_id, strlen(t.body) AS payload_bytes, sha1(t.body) AS hex, last FROM t JOIN g ON t.body = g.body)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + ((('0x' || substr(hex, 1 + 5 * (i // 4)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT, 1)), '') AS payload_digest,
    CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to FROM b""")
def op3_warc(spark: SparkSession, folder: str) -> DataFrame:
    return archived(table(spark, folder, "pages"))


@query("op5_secret_scan")
def op5_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return find_secrets(table(spark, folder, "documents")).drop("base")


@query("op11_token_counts")
def op11_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op13_token_alignment")
def op13_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignments(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op12_phrase_collocations", r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)),
p AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i, len(ws) AS m FROM w),
g AS (SELECT lang, ws[i:i + k - 1] AS ph, k FROM (SELECT *, unnest(range(1, least(4, m - i + 1) + 1)) AS k FROM p)),
f AS (SELECT lang, array_to_string(ph, ' ') AS phrase, ph, k, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
c AS (SELECT lang, phrase, k, f AS a, c, array_to_string(ph[1:c], ' ') AS head, array_to_string(ph[c + 1:k], ' ') AS tail
      FROM (SELECT *, unnest(range(1, k)) AS c FROM f WHERE k > 1)),
s AS (SELECT c.lang, c.phrase, c.k, a, x.f AS l, y.f AS r, c, (2000000::HUGEINT * a // (x.f + y.f))::BIGINT AS score
      FROM c JOIN f x ON x.lang = c.lang AND x.phrase = head JOIN f y ON y.lang = c.lang AND y.phrase = tail),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
e AS (SELECT DISTINCT o.lang, o.phrase, max(i.f) OVER (PARTITION BY o.lang, o.phrase) AS longer FROM
      (SELECT lang, f, array_to_string(ph[s:s + z - 1], ' ') AS part FROM (SELECT *, unnest(range(1, k - z + 2)) AS s FROM
        (SELECT *, unnest(range(2, k)) AS z FROM f WHERE k > 2))) i JOIN f o ON o.lang = i.lang AND o.phrase = i.part)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, n, score
FROM b JOIN n ON n.lang = b.lang LEFT JOIN e ON e.lang = b.lang AND e.phrase = b.phrase
WHERE coalesce(100::HUGEINT * longer < 80::HUGEINT * a, true) QUALIFY rank <= 2000""")
def op12_phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations(table(spark, folder, "documents"))
