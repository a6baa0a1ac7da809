"""Cleaning, key resolution and panel assembly."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelwright.functions import text as T
from panelwright.operators import boundaries as B
from panelwright.operators import lookup as L
from panelwright.operators import panel as P
from panelwright.plans.base import query


@query("""SELECT c_custkey AS id, CASE WHEN length(d) < 8 THEN lpad(d, 8, '0') ELSE d END AS code
FROM (SELECT c_custkey, CASE WHEN length(x) = 11 THEN substr(x, 1, 8) ELSE x END AS d
      FROM (SELECT c_custkey, regexp_replace(c_name, '\\D', '', 'g') AS x FROM customer))""")
def norm_code(d):
    return d.customer.select(F.col("c_custkey").alias("id"), T.norm_code(F.col("c_name")).alias("code"))


@query("""SELECT c, substr(c, 4, 2) = '00' OR substr(c, 6, 3) <> '000' AS is_summary, count(*) AS n FROM (
 SELECT lpad(CAST(p_partkey * 100 AS VARCHAR), 8, '0') AS c FROM part) GROUP BY 1, 2""")
def summary_code_filter(d):
    c = d.part.select(F.lpad((F.col("p_partkey") * 100).cast("string"), 8, "0").alias("c"))
    return c.groupBy("c", T.is_summary_code(F.col("c")).alias("is_summary")).agg(F.count("*").alias("n"))


@query("""SELECT p_partkey AS id, TRY_CAST(replace(replace(t, ',', '.'), ' ', '') AS DOUBLE) AS value FROM (
 SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'n/a' ELSE '1 ' || replace(CAST(p_size + 100 AS VARCHAR) || '.5', '.', ',') END AS t FROM part)""")
def parse_number(d):
    t = F.when(F.col("p_partkey") % 7 == 0, "n/a").otherwise(F.concat(F.lit("1 "), (F.col("p_size") + 100).cast("string"), F.lit(",5")))
    return d.part.select(F.col("p_partkey").alias("id"), T.parse_number(t).alias("value"))


@query("""SELECT p_type AS label, nullif(translate(regexp_extract(upper(l), '^(?:РАЗДЕЛ\\s+)?([A-ZАВЕКМНОРСТХ])(?:[^\\p{L}]|$)', 1), 'АВЕКМНОРСТХ', 'ABEKMHOPCTX'), '') AS section, count(*) AS n
FROM (SELECT p_type, CASE p_size % 4 WHEN 0 THEN 'Раздел С ' || p_type WHEN 1 THEN 'н. ' || p_type WHEN 2 THEN 'C' ELSE p_type END AS l FROM part) GROUP BY 1, 2""")
def section_letter(d):
    k = F.col("p_size") % 4
    label = F.when(k == 0, F.concat(F.lit("Раздел С "), "p_type")).when(k == 1, F.concat(F.lit("н. "), "p_type")).when(k == 2, "C").otherwise(F.col("p_type"))
    return d.part.groupBy(F.col("p_type").alias("label"), T.section_letter(label).alias("section")).agg(F.count("*").alias("n"))


@query("""SELECT n_nationkey AS k, regexp_replace(regexp_replace(translate(lower(n_name || ' (Old) Ё-Land'), 'ё', 'е'), '\\(.*?\\)', '', 'g'), '[^\\p{L}]', '', 'g') AS name_key,
 CASE WHEN upper(substr(n_name, 2, 1)) = substr(n_name, 2, 1) AND lower(substr(n_name, 2, 1)) <> substr(n_name, 2, 1) THEN n_name ELSE lower(substr(n_name, 1, 1)) || substr(n_name, 2) END AS short_name FROM nation""")
def name_keys(d):
    n = F.col("n_name")
    return d.nation.select(F.col("n_nationkey").alias("k"), T.name_key(F.concat(n, F.lit(" (Old) Ё-Land"))).alias("name_key"), T.short_name(F.concat(n, F.lit(" (city)"))).alias("short_name"))


@query("""SELECT event_id, array_to_string(list_sort(list_distinct([event_type, 'x', CASE WHEN value > 250 THEN 'high' ELSE 'low' END])), ';') AS flags FROM events""")
def flag_union(d):
    return d.events.select("event_id", T.union_flags(F.concat(F.lit("x;"), "event_type"), F.when(F.col("value") > 250, "high").otherwise("low;x")).alias("flags"))


@query("""SELECT district, substr(sha1(string_agg(CAST(id AS VARCHAR), ',' ORDER BY id)), 1, 12) AS fingerprint, count(*) AS n FROM entities GROUP BY 1""")
def fingerprint(d):
    return d.entities().groupBy("district").agg(T.fingerprint(F.collect_list("id")).alias("fingerprint"), F.count("*").alias("n"))


@query("""SELECT id, name FROM entities WHERE contains(lower(name), '99') ORDER BY id LIMIT 100""")
def search_contains(d):
    return d.entities().filter(F.lower("name").contains("99")).orderBy("id").limit(100).select("id", "name")


@query("""SELECT id, year, indicator, value, CASE WHEN indicator = 'spend' AND value <= 1000 THEN 'not positive' WHEN indicator = 'n_orders' AND (value < 0 OR value > 3) THEN 'out of range' END AS reason FROM long""")
def reject_split(d):
    v, i = F.col("value"), F.col("indicator")
    reason = F.when((i == "spend") & (v <= 1000), "not positive").when((i == "n_orders") & ~v.between(0, 3), "out of range")
    return d.long().withColumn("reason", reason)


@query("""SELECT id, kind FROM (SELECT id, CASE WHEN id % 7 > 0 THEN kind END AS kind, CASE WHEN id % 5 > 0 THEN district END AS level FROM entities) WHERE level = 'ASIA' AND (kind IS NULL OR kind NOT IN ('BUILDING', 'MACHINERY'))""")
def top_level_rows(d):
    """The rows of one level without two lower kinds; unknown kinds stay."""
    e = d.entities().select("id", F.when(F.col("id") % 7 > 0, F.col("kind")).alias("kind"), F.when(F.col("id") % 5 > 0, F.col("district")).alias("level"))
    return P.top_level(e, "level", "ASIA", "kind", ["BUILDING", "MACHINERY"]).select("id", "kind")


@query(""", h AS (SELECT id, year, indicator, CASE WHEN id % 9 > 0 THEN CASE WHEN indicator = 'spend' THEN value - 50000 ELSE value * 30 END END AS value FROM long)
 SELECT id, year, indicator, round(value, 4) AS value, CASE WHEN indicator = 'spend' THEN 'not positive' ELSE 'not between 0 and 100' END AS reason FROM h WHERE (indicator = 'spend' AND value <= 0) OR (indicator = 'n_orders' AND (value IS NULL OR value NOT BETWEEN 0 AND 100))""")
def rejected_rows(d):
    """What is rejected, missing percentages among it."""
    v = F.when(F.col("id") % 9 > 0, F.when(F.col("indicator") == "spend", F.col("value") - 50000).otherwise(F.col("value") * 30))
    return P.reject_invalid(d.long().withColumn("value", v), ["spend"], ["n_orders"])[1].withColumn("value", F.round("value", 4))


_TWO = """, sources AS (SELECT id, year, spend AS value, 0 AS priority FROM wide WHERE id % 3 <> 0
 UNION ALL SELECT id, year, n_orders * 1000.0, 1 FROM wide)"""


def _two(d):
    w = d.wide()
    return w.filter("id % 3 <> 0").select("id", "year", F.col("spend").alias("value"), F.lit(0).alias("priority")).unionByName(w.select("id", "year", (F.col("n_orders") * 1000.0).alias("value"), F.lit(1).alias("priority")))


@query(_TWO + """SELECT id, year, value, CAST(priority AS BIGINT) AS priority FROM sources QUALIFY priority = min(priority) OVER (PARTITION BY id, year)""")
def priority_coalesce(d):
    return P.prefer(_two(d), ["id", "year"], "value", "priority").withColumn("priority", F.col("priority").cast("long"))


@query(_TWO + """SELECT id, year, value FROM sources WHERE priority = 0 UNION ALL
 SELECT id, year, value FROM sources s WHERE priority = 1 AND NOT EXISTS (SELECT 1 FROM sources t WHERE t.priority = 0 AND t.id = s.id AND t.year = s.year)""")
def fill_anti_join(d):
    s = _two(d)
    return P.fill_absent(s.filter("priority = 0").select("id", "year", "value"), s.filter("priority = 1").select("id", "year", "value"), keys=["id", "year"])


_VERSIONS = """, versions AS (
 SELECT id, 'c' || CAST(id // 2 AS VARCHAR) AS code, 0 AS year_from, CASE WHEN id % 2 = 0 THEN 1998 ELSE 9999 END AS year_to FROM entities WHERE id % 5 <> 0
 UNION ALL SELECT id, 'd' || CAST(id AS VARCHAR), 1998, 9999 FROM entities WHERE id % 2 = 0 AND id % 5 <> 0)"""


def _versions(d):
    e = d.entities().filter("id % 5 <> 0")
    a = e.select("id", F.concat(F.lit("c"), F.floor(F.col("id") / 2).cast("string")).alias("code"), F.lit(0).alias("year_from"), F.when(F.col("id") % 2 == 0, 1998).otherwise(9999).alias("year_to"))
    b = e.filter("id % 2 = 0").select("id", F.concat(F.lit("d"), F.col("id").cast("string")).alias("code"), F.lit(1998).alias("year_from"), F.lit(9999).alias("year_to"))
    return a.unionByName(b)


_ROWS = """, obs AS (SELECT id AS true_id, year, CASE WHEN id % 2 = 0 AND year >= 1998 THEN 'd' || CAST(id AS VARCHAR) ELSE 'c' || CAST(id // 2 AS VARCHAR) END AS code,
 CASE WHEN id % 3 = 0 THEN 'd' || CAST(id AS VARCHAR) ELSE 's' || CAST(id AS VARCHAR) END AS stable FROM wide)"""


def _rows(d):
    i = F.col("id").cast("string")
    code = F.when((F.col("id") % 2 == 0) & (F.col("year") >= 1998), F.concat(F.lit("d"), i)).otherwise(F.concat(F.lit("c"), F.floor(F.col("id") / 2).cast("string")))
    return d.wide().select(F.col("id").alias("true_id"), "year", code.alias("code"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("d"), i)).otherwise(F.concat(F.lit("s"), i)).alias("stable"))


@query(_VERSIONS + _ROWS + """, held AS (SELECT code, min(id) AS one, count(DISTINCT id) AS n FROM versions GROUP BY 1),
 s AS (SELECT o.*, v.id AS by_year, CASE WHEN h.n = 1 THEN h.one END AS by_code, CASE WHEN g.n = 1 THEN g.one END AS by_stable, coalesce(h.n, 0) AS n1, coalesce(g.n, 0) AS n2
  FROM obs o LEFT JOIN versions v ON v.code = o.code AND v.year_from <= greatest(o.year, 1996) AND greatest(o.year, 1996) < v.year_to
  LEFT JOIN held h ON h.code = o.code LEFT JOIN held g ON g.code = o.stable),
 t AS (SELECT *, coalesce(by_year, by_code, by_stable) AS now FROM s),
 peers AS (SELECT stable, CASE WHEN count(DISTINCT now) = 1 THEN min(now) END AS peer FROM t WHERE now IS NOT NULL GROUP BY 1)
 SELECT true_id, year, code, stable, coalesce(now, peer) AS id_resolved, CASE WHEN by_year IS NOT NULL THEN 'by_year' WHEN by_code IS NOT NULL THEN 'by_code' WHEN by_stable IS NOT NULL THEN 'by_stable'
  WHEN peer IS NOT NULL THEN 'by_peer' WHEN greatest(n1, n2) > 1 THEN 'ambiguous' ELSE 'absent' END AS match FROM t LEFT JOIN peers USING (stable)""")
def resolve_multistage(d):
    return P.resolve(_rows(d), _versions(d), "code", "stable", first_year=1996)


@query(_VERSIONS + """SELECT w.id, w.year, w.spend FROM wide w WHERE EXISTS (SELECT 1 FROM versions v WHERE v.id = w.id AND v.year_from <= w.year AND w.year < v.year_to AND v.code LIKE 'c%')""")
def valid_in_year(d):
    return P.valid_in_year(d.wide(), _versions(d).filter(F.col("code").startswith("c"))).select("id", "year", "spend")


@query("""SELECT user_id, event_type, value, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY value > 400, event_id) = 1""")
def dedupe_pref(d):
    e = d.events.select("user_id", "event_type", F.struct((F.col("value") > 400).alias("late"), "event_id").alias("o"), "value", "event_id")
    return e.groupBy("user_id", "event_type").agg(F.min_by(F.struct("value", "event_id"), "o").alias("b")).select("user_id", "event_type", "b.value", "b.event_id")


@query(""", p AS (SELECT user_id, event_type, CAST(day(ts) % 3 AS BIGINT) AS pref, value FROM events)
SELECT user_id, event_type, pref, round(sum(value), 4) AS value FROM p QUALIFY FALSE OR pref = min(pref) OVER (PARTITION BY user_id, event_type) GROUP BY 1, 2, 3""".replace(" QUALIFY FALSE OR pref = min(pref) OVER (PARTITION BY user_id, event_type) GROUP BY 1, 2, 3", " WHERE (user_id, event_type, pref) IN (SELECT user_id, event_type, min(pref) FROM p GROUP BY 1, 2) GROUP BY 1, 2, 3"))
def annual_period_pick(d):
    p = d.events.groupBy("user_id", "event_type", (F.dayofmonth("ts") % 3).cast("long").alias("pref")).agg(F.round(F.sum("value"), 4).alias("value"))
    return p.groupBy("user_id", "event_type").agg(F.min_by(F.struct("pref", "value"), "pref").alias("b")).select("user_id", "event_type", "b.*")


_COLLAPSE = """, r AS (SELECT l_suppkey AS k, CAST(year(l_shipdate) AS BIGINT) AS year, l_returnflag AS f, l_linestatus AS code, l_extendedprice AS v, l_quantity AS w, l_orderkey * 10 + l_linenumber AS o FROM lineitem),
 g AS (SELECT k, year, f, count(DISTINCT v) AS n, sum(v) AS s, sum(v * w) / nullif(sum(w), 0) AS m, arg_max(v, o) AS p, any_value(v) AS one FROM r GROUP BY 1, 2, 3)
 SELECT k, year, f, round(CASE WHEN n = 1 THEN one WHEN f = 'A' THEN s WHEN f = 'N' THEN m ELSE p END, 6) AS value, CASE WHEN n = 1 THEN '' WHEN f = 'R' THEN 'duplicate_codes' ELSE 'merged_sources' END AS flag FROM g"""


@query(_COLLAPSE)
def collapse_sum_mean(d):
    return _collapsed(d.lineitem)


@query(_COLLAPSE)
def collapse_all_sources(d):
    """An older name of :func:`collapse_sum_mean`."""
    return _collapsed(d.lineitem)


def _collapsed(lines):
    r = lines.select(F.col("l_suppkey").alias("k"), F.year("l_shipdate").cast("long").alias("year"), F.col("l_returnflag").alias("f"), F.col("l_extendedprice").alias("v"), F.col("l_quantity").alias("w"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("o"))
    rule = F.when(F.col("f") == "A", "sum").when(F.col("f") == "N", "mean").otherwise("pick")
    return P.collapse(r, ["k", "year", "f"], "v", "w", rule, "o", F.lit(0)).withColumn("value", F.round("value", 6))


@query(""", ev AS (SELECT id AS succ, 1998 AS event_year, [id, id + 1, id + 2] AS preds FROM entities WHERE id % 50 = 0),
 e AS (SELECT succ, event_year, len(preds) AS need, unnest(preds) AS id FROM ev)
 SELECT succ AS id, year, indicator, round(sum(value), 4) AS value FROM long JOIN e USING (id) WHERE year < event_year GROUP BY 1, 2, 3, need HAVING count(*) = need""")
def predecessor_sum(d):
    i = F.col("id")
    ev = d.entities().filter("id % 50 = 0").select(i.alias("succ"), F.lit(1998).alias("event_year"), F.array(i, i + 1, i + 2).alias("preds"))
    return P.predecessor_sum(d.long(), ev).withColumn("value", F.round("value", 4))


_BACK = """, one AS (SELECT 'union_a' || CAST(id AS VARCHAR) AS event, id AS succ, id + 1 AS p, id + 2 AS q, 1996 AS until FROM entities WHERE id % 50 = 0),
 two AS (SELECT 'union_b' || CAST(id AS VARCHAR) AS event, id + 75 AS succ, id AS p, id + 50 AS q, 1997 AS until FROM entities WHERE id % 100 = 0),
 three AS (SELECT 'transfer_c' || CAST(id AS VARCHAR) AS event, id + 80 AS succ, id + 75 AS p, 1998 AS until FROM entities WHERE id % 100 = 0),
 r1 AS (SELECT succ AS id, x.year, x.indicator, CASE WHEN x.indicator = 'spend' THEN x.value + y.value ELSE (x.value * u.value + y.value * v.value) / (u.value + v.value) END AS value, 'summed_predecessors:' || event AS flag
  FROM one JOIN long x ON x.id = p JOIN long y ON y.id = q AND y.year = x.year AND y.indicator = x.indicator JOIN long u ON u.id = p AND u.year = x.year AND u.indicator = 'spend' JOIN long v ON v.id = q AND v.year = x.year AND v.indicator = 'spend'
  WHERE x.year < until AND NOT EXISTS (SELECT 1 FROM long l WHERE l.id = succ AND l.year = x.year AND l.indicator = x.indicator)),
 l1 AS (SELECT id, year, indicator, value FROM long UNION ALL SELECT id, year, indicator, value FROM r1),
 r2 AS (SELECT succ AS id, x.year, x.indicator, CASE WHEN x.indicator = 'spend' THEN x.value + y.value ELSE (x.value * u.value + y.value * v.value) / (u.value + v.value) END AS value, 'summed_predecessors:' || event AS flag
  FROM two JOIN l1 x ON x.id = p JOIN l1 y ON y.id = q AND y.year = x.year AND y.indicator = x.indicator JOIN l1 u ON u.id = p AND u.year = x.year AND u.indicator = 'spend' JOIN l1 v ON v.id = q AND v.year = x.year AND v.indicator = 'spend'
  WHERE x.year < until AND NOT EXISTS (SELECT 1 FROM l1 l WHERE l.id = succ AND l.year = x.year AND l.indicator = x.indicator)),
 l2 AS (SELECT * FROM l1 UNION ALL SELECT id, year, indicator, value FROM r2),
 r3 AS (SELECT succ AS id, x.year, x.indicator, x.value, 'moved_predecessor:' || event AS flag FROM three JOIN l2 x ON x.id = p
  WHERE x.year < until AND NOT EXISTS (SELECT 1 FROM l2 l WHERE l.id = succ AND l.year = x.year AND l.indicator = x.indicator))
 SELECT id, year, indicator, round(value, 4) AS value, flag FROM (FROM r1 UNION ALL FROM r2 UNION ALL FROM r3)"""


@query(_BACK)
def events_back(d):
    """Two rounds of unions and a transfer, each reading what the ones before have derived: spend is summed, orders are a mean by spend."""
    e, i = d.entities().select("id"), F.col("id")
    name = lambda kind: F.concat(F.lit(kind), i.cast("string")).alias("event")
    event = lambda rows, mark, kind, year, preds, succ: rows.select(name(mark), F.lit(kind).alias("kind"), F.lit(year).alias("year"), F.array(*preds).alias("preds"), F.array(succ).alias("succs"))
    hundred = e.filter("id % 100 = 0")
    events = event(e.filter("id % 50 = 0"), "union_a", "union", 1996, [i + 1, i + 2], i)
    events = events.unionByName(event(hundred, "union_b", "union", 1997, [i, i + 50], i + 75)).unionByName(event(hundred, "transfer_c", "transfer", 1998, [i + 75, i + 60], i + 80))
    rules = d.spark.createDataFrame([("spend", "sum", None), ("n_orders", "mean", "spend")], "indicator string, agg string, weight string")
    codes = e.select("id", i.alias("code")).unionByName(hundred.select((i + 80).alias("id"), (i + 75).alias("code"))).unionByName(hundred.select((i + 75).alias("id"), (i + 75).alias("code")))
    return B.extend_back(d.long(), events, rules, codes).withColumn("value", F.round("value", 4))


@query("""SELECT s.id, s.year, s.section, s.value, round(sum(s.value) OVER (PARTITION BY s.id, s.year), 4) > 1.05 * (w.spend * (1 - (s.id % 4) / 10.0)) AS anomaly FROM sections s JOIN wide w USING (id, year)""")
def sector_anomaly(d):
    s = d.sections()
    total = d.wide().select("id", "year", (F.col("spend") * (1 - (F.col("id") % 4) / 10.0)).alias("total"))
    w = W.partitionBy("id", "year")
    return s.join(total, ["id", "year"]).select("id", "year", "section", "value", (F.round(F.sum("value").over(w), 4) > 1.05 * F.col("total")).alias("anomaly"))


@query(""", x AS (SELECT *, lag(spend) OVER w AS b, lead(spend) OVER w AS a FROM wide WINDOW w AS (PARTITION BY id ORDER BY year))
 SELECT id, year, spend, coalesce((spend / nullif(b, 0) - 1 > 0.2 AND spend / nullif(a, 0) - 1 > 0.2) OR (spend / nullif(b, 0) - 1 < -0.2 AND spend / nullif(a, 0) - 1 < -0.2), FALSE) AS spike FROM x""")
def jump_flag(d):
    return P.neighbour_spikes(d.wide().select("id", "year", "spend"), "spend", 0.2)


@query(""", m AS (SELECT user_id, CAST(day(ts) AS BIGINT) AS day, sum(value) AS total, sum(CASE WHEN event_type = 'click' THEN value END) AS click FROM events GROUP BY 1, 2)
 SELECT user_id, round(avg(total), 7) AS mean_total, count(*) AS n_days, round(sum(click) / nullif(sum(total), 0), 6) AS share_click, round(1 - coalesce(sum(click) / nullif(sum(total), 0), 0), 6) AS share_other, count(*) < 12 AS lt12 FROM m GROUP BY 1""")
def monthly_to_annual_shares(d):
    m = d.events.groupBy("user_id", F.dayofmonth("ts").cast("long").alias("day")).agg(F.sum("value").alias("total"), F.sum(F.when(F.col("event_type") == "click", F.col("value"))).alias("click"))
    share = F.try_divide(F.sum("click"), F.sum("total"))
    return m.groupBy("user_id").agg(F.round(F.avg("total"), 7).alias("mean_total"), F.count("*").alias("n_days"), F.round(share, 6).alias("share_click"), F.round(1 - F.coalesce(share, F.lit(0.0)), 6).alias("share_other"), (F.count("*") < 12).alias("lt12"))


@query("""SELECT id, year, max(CASE WHEN indicator = 'spend' THEN value END) AS spend, max(CASE WHEN indicator = 'n_orders' THEN value END) AS n_orders FROM long GROUP BY 1, 2""")
def long_to_wide(d):
    return d.long().groupBy("id", "year").pivot("indicator", ["spend", "n_orders"]).agg(F.first("value"))


@query("""SELECT * FROM long""")
def wide_to_long(d):
    return d.long()


@query(_VERSIONS + """SELECT id, arg_max(code, year_from) AS code, string_agg(code || '@' || CAST(year_from AS VARCHAR), '; ' ORDER BY year_from) AS history, CAST(min(year_from) AS BIGINT) AS first_year FROM versions GROUP BY 1""")
def dim_latest_version(d):
    h = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("year_from", "code"))), lambda x: F.concat(x["code"], F.lit("@"), x["year_from"].cast("string"))), "; ")
    return _versions(d).groupBy("id").agg(F.max_by("code", "year_from").alias("code"), h.alias("history"), F.min("year_from").cast("long").alias("first_year"))


_SIDES = """SELECT coalesce(a.region, b.region) AS region, a.ids AS priced, b.ids AS plain FROM
 (SELECT region, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids FROM entities WHERE id % 2 = 0 GROUP BY 1) a FULL JOIN
 (SELECT region, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids FROM entities WHERE id % 2 <> 0 GROUP BY 1) b ON a.region = b.region"""


@query(_SIDES)
def boundary_events(d):
    """Every entity stands on one side, even ids against odd ones."""
    e = d.entities()
    return _aligned(e.filter("id % 2 = 0"), e.filter("id % 2 <> 0"))


@query(_SIDES)
def boundary_all_events(d):
    """An older name of :func:`boundary_events`."""
    return boundary_events(d)


def _aligned(priced, plain):
    def ids(e, name):
        return e.groupBy("region").agg(F.array_join(F.transform(F.array_sort(F.collect_set("id")), lambda x: x.cast("string")), ",").alias(name))

    return ids(priced, "priced").join(ids(plain, "plain"), "region", "full_outer").select("region", "priced", "plain")


@query("""SELECT p.p_partkey AS id, arg_max(x.prefix, length(x.prefix)) AS prefix FROM part p JOIN (SELECT DISTINCT substr(p_name, 1, CAST(2 + p_partkey % 5 AS INT)) AS prefix FROM part WHERE p_partkey % 11 = 0) x ON starts_with(p.p_name, x.prefix) GROUP BY 1""")
def prefix_join(d):
    """The longest of a list of prefixes (beginnings of some names) that each name has."""
    some = d.part.filter("p_partkey % 11 = 0").select(F.expr("substr(p_name, 1, 2 + p_partkey % 5)").alias("prefix"))
    return L.longest_prefix(d.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), some)


@query("""SELECT p.p_partkey AS id, x.part FROM part p JOIN (SELECT DISTINCT substr(p_name, CAST(1 + p_partkey % 5 AS INT), CAST(p_partkey % 7 AS INT)) AS part FROM part WHERE p_partkey % 13 = 0) x ON contains(p.p_name, x.part)""")
def name_parts(d):
    """Every name that contains one of a list of parts, short and empty ones among them."""
    some = d.part.filter("p_partkey % 13 = 0").select(F.expr("substr(p_name, 1 + p_partkey % 5, p_partkey % 7)").alias("part"))
    return L.containing(d.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), some, []).select("id", "part")


@query("""SELECT user_id, event_type, count(DISTINCT value) AS n_values, count(DISTINCT value) > 1 AS conflict, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1, 2""")
def key_conflicts(d):
    return d.events.groupBy("user_id", "event_type").agg(F.count_distinct("value").alias("n_values"), (F.count_distinct("value") > 1).alias("conflict"), F.min("value").alias("lo"), F.max("value").alias("hi"))
