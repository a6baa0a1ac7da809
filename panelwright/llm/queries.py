"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, scratch
from .decontaminate import decontaminate
from .divergence import divergence
from .html_extract import extract_text
from .jaccard import jaccard_classes
from .merkle import tamper_report
from .mixing import mix, mix_report
from .packing import pack
from .pii import pii_report
from .quality import quality_rules
from .sharding import place
from .token_files import read_token_files, write_token_files
from .tokens import tokenizer_path
from .toxicity import toxicity
from .url_filter import url_filter

ALLOW = ["com/", "www.example.com/en/"]
BLOCK = ["example.com/en/", "net/es/", "net/fr/"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages").select("page_id", "url"), ALLOW, BLOCK).select("page_id", "host", "path", "rule", "verdict")


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = jaccard_classes(table(spark, sf_dir, "documents"), shingle=3, percent=90)
    return got.select("doc_id", "n_shingles", "component_id")


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    got = pages.select("page_id", "url", extract_text(pages, "html").alias("text"))
    return got.withColumn("n_chars", F.length("text").cast("long"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pack(docs, tokenizer_path("word_bpe_49k.json"), end_id=2, style="words", window=4096, with_ids=False)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path, tokenizer_path("byte_bpe_50k.json"), end_id=0, style="spaces")
    return read_token_files(spark, path, with_ids=False)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = [f"shard-{i:03d}" for i in range(64)]
    return place(table(spark, sf_dir, "documents"), shards).select("doc_id", "slot", "shard")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_report(table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), length=10)
    return got.drop("spans")


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch(spark) as keep:
        return keep(mix_report(mix(table(spark, sf_dir, "documents"), weights=(3, 1, 2))), "mix")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch(spark) as keep:
        return keep(tamper_report(table(spark, sf_dir, "documents")), "manifest")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch(spark) as keep:
        return keep(divergence(table(spark, sf_dir, "documents")), "divergence")


_QUERIES = (
    op1_url_filter, op2_ngram_jaccard_join, op3_html_extract, op4_packing, op5_token_files,
    op6_sharding, op7_toxicity, op8_quality_rules, op9_pii, op10_decontaminate,
    op11_mixing, op12_merkle_manifest, op13_source_divergence,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


_OP1 = r"""
WITH cut AS (
  SELECT page_id, lower_ascii(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)) AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM (SELECT page_id, url FROM pages)
), rules(rule_host, rule_path, verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
         ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), fit AS (
  SELECT c.*, r.rule_host || r.rule_path AS rule, r.verdict,
         row_number() OVER (PARTITION BY c.page_id, c.host, c.path ORDER BY length(r.rule_host || r.rule_path) DESC NULLS LAST) AS nth
  FROM cut c LEFT JOIN rules r
    ON (c.host = r.rule_host OR ends_with(c.host, '.' || r.rule_host)) AND starts_with(c.path, r.rule_path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fit WHERE nth = 1
"""
_ASCII = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP2 = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all({_ASCII.format('text')}, '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
  FROM words
), one AS (SELECT doc_id, len(coalesce(s, [])) AS n, unnest(s) AS g FROM sets),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i, any_value(a.n) AS nx, any_value(b.n) AS ny
  FROM one a JOIN one b ON a.g = b.g AND a.doc_id <> b.doc_id AND least(a.n, b.n) * 100 >= 90 * greatest(a.n, b.n)
  GROUP BY 1, 2
), links AS (SELECT x, y FROM shared WHERE 100 * i >= 90 * (nx + ny - i)),
reach AS (
  SELECT doc_id AS x, doc_id AS r FROM documents
  UNION
  SELECT l.x, reach.r FROM links l JOIN reach ON l.y = reach.x
)
SELECT s.doc_id, CAST(len(coalesce(s.s, [])) AS BIGINT) AS n_shingles, min(r.r) AS component_id
FROM sets s JOIN reach r ON r.x = s.doc_id GROUP BY s.doc_id, s.s
"""

_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_OP10 = rf"""
WITH d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
b AS (SELECT item_id, coalesce({_WORDS}, []) AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)
), m AS (SELECT doc_id, item_id, n, i FROM dw JOIN bw USING (n, g)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
      FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(t.ids, '')) AS items_sha256,
       coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""


_OP11 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '-')) AS k,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents
), s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
w AS (SELECT *, [3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS w, sum(source_size) OVER () AS whole FROM s),
-- The least size for its weight first: a source is full if what those before it leave, shared by weight, is more than it has.
o AS (
  SELECT *, coalesce(sum(2 * source_size) OVER (q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS given, sum(w) OVER (q ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights
  FROM w WINDOW q AS (ORDER BY source_size * 1.0 / w, source NULLS LAST)
), f AS (SELECT *, w * (3 * whole - 2 * given) > 4 * source_size * weights AS above FROM o),
l AS (SELECT coalesce(sum(2 * source_size) FILTER (above), 0) AS given, sum(w) FILTER (NOT above) AS weights FROM f),
t AS (
  SELECT source, source_size, w, CASE WHEN above THEN CAST(2 * source_size AS DOUBLE) ELSE CAST(w * (3 * whole - 2 * l.given) AS DOUBLE) / (2 * l.weights) END AS target,
    CASE WHEN above THEN 2 * source_size ELSE w * (3 * whole - 2 * l.given) // (2 * l.weights) END AS goal
  FROM f, l
), q AS (
  SELECT d.*, t.source_size, t.target, t.goal, t.w, row_number() OVER x AS ordinal, coalesce(sum(size) OVER (x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source WINDOW x AS (PARTITION BY d.source ORDER BY k, doc_id, size, r)
), lap AS (
  SELECT q.*, lap, greatest(least(goal - (lap * source_size + before), size), 0) AS taken, CAST(lap * source_size + before + size AS DOUBLE) / w AS finish
  FROM q, (SELECT unnest([0, 1]) AS lap)
), m AS (SELECT *, coalesce(sum(taken) OVER (ORDER BY finish, source NULLS LAST, lap, ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS position FROM lap)
SELECT doc_id, size, source_size, target, CAST(sum(taken) AS BIGINT) AS taken, CAST(min(position) FILTER (taken > 0) AS BIGINT) AS position
FROM m GROUP BY r, doc_id, size, source_size, target
"""

# crc32 of the ASCII digits of an id, bit by bit; the constant is its published polynomial.
_CRC = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, len({0}) + 1), lambda i: CAST(ascii({0}[i]) AS BIGINT))),
  lambda a, b: list_reduce(list_prepend(xor(a, b), [CAST(0 AS BIGINT) for z in range(8)]), lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)), 4294967295)"""


def _field(c: str) -> str:
    return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')"


_LEAF = "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars")) + " || {})"
_OP12 = rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, source, {_LEAF.format(_field('text'))} AS leaf,
    CASE WHEN {_CRC.format('CAST(doc_id AS VARCHAR)')} % 5 = 0 THEN {_LEAF.format(_field(_ASCII.format('text')))} END AS other
  FROM documents
), g AS (SELECT source AS s, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS g, count(*) AS n FROM d GROUP BY source),
leaves AS (SELECT r, g, n, leaf AS h, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d JOIN g ON source IS NOT DISTINCT FROM s),
low AS (
  SELECT 0 AS level, g, i, n, h FROM leaves
  UNION ALL
  SELECT level + 1, g, i // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY i)) FROM low WHERE n > 1 GROUP BY level, g, i // 16, n
), sub AS (SELECT g, h FROM low WHERE n = 1),
high AS (
  SELECT 0 AS level, g AS i, count(*) OVER () AS n, h FROM sub
  UNION ALL
  SELECT level + 1, i // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY i)) FROM high WHERE n > 1 GROUP BY level, i // 16, n
), steps AS (
  SELECT x.r, y.level, coalesce(string_agg(z.h, '' ORDER BY z.i) FILTER (z.i < y.i), '') AS a, coalesce(string_agg(z.h, '' ORDER BY z.i) FILTER (z.i > y.i), '') AS b
  FROM leaves x JOIN low y ON y.g = x.g AND y.i = CAST(floor(x.i / pow(16, y.level)) AS BIGINT) AND y.n > 1
  JOIN low z ON z.g = y.g AND z.level = y.level AND z.i // 16 = y.i // 16 GROUP BY x.r, y.level
  UNION ALL
  SELECT x.r, 1000 + y.level, coalesce(string_agg(z.h, '' ORDER BY z.i) FILTER (z.i < y.i), ''), coalesce(string_agg(z.h, '' ORDER BY z.i) FILTER (z.i > y.i), '')
  FROM leaves x JOIN high y ON y.i = CAST(floor(x.g / pow(16, y.level)) AS BIGINT) AND y.n > 1
  JOIN high z ON z.level = y.level AND z.i // 16 = y.i // 16 GROUP BY x.r, y.level
), path AS (SELECT r, list(a || '-' || b ORDER BY level) AS p, sha256(string_agg(a || b, '' ORDER BY level)) AS proof FROM steps GROUP BY r),
folded AS (
  SELECT d.r, coalesce(other, leaf) AS h, 1 AS k FROM d
  UNION ALL
  SELECT f.r, sha256(replace(p[k], '-', h)), k + 1 FROM folded f JOIN path USING (r) WHERE k <= len(p)
), ended AS (SELECT r, arg_max(h, k) AS h FROM folded GROUP BY r)
SELECT d.doc_id, d.leaf, sub.h AS subroot, root.h AS root, coalesce(proof, sha256('')) AS proof_sha256, ended.h AS folded_root, ended.h = root.h AS verified
FROM d JOIN leaves USING (r) JOIN sub ON sub.g = leaves.g JOIN ended ON ended.r = d.r LEFT JOIN path ON path.r = d.r, (SELECT h FROM high WHERE n = 1) root
"""

_OP13 = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY 1, 2 HAVING count(DISTINCT r) >= 10),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
s AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY 1, 2),
p AS (
  SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (coalesce(s.n, 0)::HUGEINT + 2 * v.v) AS p,
    1 + 1000000000::HUGEINT * (kept.n + 2) // (v.n::HUGEINT + 2 * v.v) AS q
  FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term) LEFT JOIN s USING (lang, source)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3
), parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts) WHERE part = 'pair' OR rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_url_filter": _OP1.replace("lower_ascii(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1))", "coalesce(" + _ASCII.format("regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)") + ", '')"),
        "op2_ngram_jaccard_join": _OP2,
        "op10_decontaminate": _OP10,
        "op11_mixing": _OP11,
        "op12_merkle_manifest": _OP12,
        "op13_source_divergence": _OP13,
    }
