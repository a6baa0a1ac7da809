"""Totals, successors, coverage and gaps, numbers of clusters, and what describes a cluster."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelwright.operators import reports as R
from panelwright.plans.base import query

_TOTALS = """CASE WHEN p_size % 5 = 0 THEN 'Всего, ' || p_brand ELSE p_brand END AS a, p_type AS b, CASE p_size % 3 WHEN 0 THEN 'main' WHEN 1 THEN 'spare' ELSE 'none' END AS c"""


@query(f"""SELECT p_partkey AS id, a, b, c, CASE c WHEN 'spare' THEN 0 ELSE 1 END AS preference FROM (SELECT p_partkey, {_TOTALS} FROM part)
 WHERE (starts_with(a, 'Всего') OR NOT EXISTS (SELECT 1 FROM part WHERE p_size % 5 = 0)) AND c IN ('spare', 'main')""", views=False)
def total_rows(d):
    """Of three dimensions, the first has totals, the second has none, and the third has a rule."""
    p = d.part.select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 5 == 0, F.concat(F.lit("Всего, "), "p_brand")).otherwise(F.col("p_brand")).alias("a"), F.col("p_type").alias("b"), F.when(F.col("p_size") % 3 == 0, "main").when(F.col("p_size") % 3 == 1, "spare").otherwise("none").alias("c"))
    return R.totals(p, R.dimensions(p, ["id"]), {"c": ["spare", "main"]})


@query(""", moved AS (SELECT id + 1 AS id, year, indicator, value, 'linked' AS flag FROM long WHERE id % 3 = 0 AND year < 1996)
 SELECT id, year, indicator, value, CAST(NULL AS VARCHAR) AS flag FROM long UNION ALL SELECT * FROM moved m WHERE NOT EXISTS (SELECT 1 FROM long l WHERE l.id = m.id AND l.year = m.year AND l.indicator = m.indicator)""")
def successor_append(d):
    """Values of a predecessor before 1996 go to its successor where that has none."""
    rows = d.long()
    moved = rows.filter("id % 3 = 0 AND year < 1996").select((F.col("id") + 1).alias("id"), "year", "indicator", "value", F.lit("linked").alias("flag"))
    return R.append_new(rows, moved, ["id", "year", "indicator"])


@query("""SELECT l_returnflag AS flag, l_linestatus AS status, CASE WHEN l_linenumber > 4 THEN NULL ELSE l_linenumber END AS line, min(year(l_shipdate)) || '–' || max(year(l_shipdate)) AS years, count(*) AS n FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey AND s_nationkey < 5 WHERE s_suppkey IS NULL GROUP BY 1, 2, 3""", views=False)
def unmatched_log(d):
    """What has no match, by its keys, nulls among them: the years and the number of rows."""
    s = d.supplier.filter("s_nationkey < 5").select(F.col("s_suppkey").alias("l_suppkey"))
    left = d.lineitem.select("l_suppkey", "l_returnflag", "l_linestatus", "l_linenumber", F.year("l_shipdate").alias("y")).join(s, "l_suppkey", "left_anti")
    keys = [F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.when(F.col("l_linenumber") <= 4, F.col("l_linenumber")).alias("line")]
    return left.groupBy(*keys).agg(F.concat(F.min("y").cast("string"), F.lit("–"), F.max("y").cast("string")).alias("years"), F.count("*").alias("n"))


_NAMES = ", ent AS (SELECT id, region, 'town ' || (id % 400) AS short, 'Town ' || (id % 400) || ' on ' || kind AS name FROM entities), nam AS (SELECT DISTINCT region, CASE WHEN id % 2 = 0 THEN 'town ' || (id % 400) ELSE 'town ' || (id % 400) || 'xy' END AS stem FROM entities)"


@query(_NAMES + """, j AS (SELECT n.region, n.stem, e.id, lower(e.short) = n.stem AS exact, contains(lower(e.name), substr(n.stem, 1, greatest(length(n.stem) - 2, 0))) AS inside FROM nam n LEFT JOIN ent e USING (region))
 SELECT region, stem, CASE WHEN count(*) FILTER (exact) = 1 THEN max(id) FILTER (exact) WHEN count(*) FILTER (inside) = 1 THEN max(id) FILTER (inside) END AS id FROM j GROUP BY 1, 2""")
def name_lookup(d):
    """Entities by short name, or by a part of the name; only if one fits."""
    e = d.entities()
    town = F.concat(F.lit("town "), (F.col("id") % 400).cast("string"))
    ent = e.select("region", "id", town.alias("short"), F.concat(F.initcap(town), F.lit(" on "), "kind").alias("name"))
    nam = e.select("region", F.when(F.col("id") % 2 == 0, town).otherwise(F.concat(town, F.lit("xy"))).alias("stem"))
    return R.by_name(nam, ent)


@query(""", p AS (SELECT id, year, CASE WHEN id % 4 > 0 THEN n_orders END AS pop FROM wide), g AS (SELECT region, t.year, t.label, CAST(sum(coalesce(pop, 0)) AS BIGINT) AS pop, count(*) AS n FROM types t JOIN entities USING (id) LEFT JOIN p USING (id, year) GROUP BY 1, 2, 3)
 SELECT row_number() OVER (PARTITION BY year ORDER BY pop DESC, region, label) AS place, region, year, label, pop, n, round(pop / nullif(sum(pop) OVER (PARTITION BY region, year), 0), 6) AS share FROM g""")
def subject_table(d):
    """Types of a region's entities by number and people; who isn't counted has none."""
    p = d.wide().filter("id % 4 > 0").select("id", "year", F.col("n_orders").alias("pop"))
    t = d.types().join(d.entities().select("id", "region"), "id").join(p, ["id", "year"], "left")
    g = t.groupBy("region", "year", "label").agg(F.sum(F.coalesce("pop", F.lit(0))).alias("pop"), F.count("*").alias("n"))
    place = F.row_number().over(W.partitionBy("year").orderBy(F.desc("pop"), "region", "label"))  # a row a region and type
    share = F.try_divide(F.col("pop"), F.sum("pop").over(W.partitionBy("region", "year")))
    return g.select(place.alias("place"), "region", "year", "label", "pop", "n", F.round(share, 6).alias("share"))


_HELD = ", held AS (SELECT region, year, indicator, CASE WHEN region % 6 = 1 AND id % 5 > 0 AND indicator = 'spend' THEN NULL ELSE value END AS value FROM long JOIN entities USING (id))"


@query(_HELD + """, r AS (SELECT region, indicator, year, 100.0 * count(value) / count(*) AS coverage FROM held GROUP BY 1, 2, 3), c AS (SELECT indicator, year, 100.0 * count(value) / count(*) AS country FROM held GROUP BY 1, 2)
 SELECT region, indicator, year, round(coverage, 4) AS coverage, round(country, 4) AS country FROM r JOIN c USING (indicator, year) WHERE coverage < 50 AND country >= 80""")
def regional_gaps(d):
    hidden = (F.col("region") % 6 == 1) & (F.col("id") % 5 > 0) & (F.col("indicator") == "spend")
    v = d.long().join(d.entities().select("id", "region"), "id").withColumn("value", F.when(~hidden, F.col("value")))
    return R.gaps(v).select("region", "indicator", "year", F.round("coverage", 4).alias("coverage"), F.round("country", 4).alias("country"))


@query("""SELECT w.year, count(DISTINCT w.id) FILTER (n_orders > 1) AS n, round(100.0 * count(DISTINCT w.id) FILTER (n_orders > 1) / (SELECT count(*) FROM entities), 4) AS share, round(100.0 * count(DISTINCT w.id) FILTER (n_orders > 1 AND district = 'ASIA') / (SELECT count(*) FROM entities WHERE district = 'ASIA'), 4) AS share_asia
 FROM wide w JOIN entities USING (id) GROUP BY 1""")
def inventory_coverage(d):
    """Entities with a value in a year, of all and of a district's."""
    e = d.entities().select("id", "district")
    all_ = e.agg(F.count("*").alias("n_all"), F.count_if(F.col("district") == "ASIA").alias("n_asia"))
    have = d.wide().filter("n_orders > 1").join(e, "id").select("year", "id", "district").distinct()
    years = d.wide().select("year").distinct()
    g = years.join(have.groupBy("year").agg(F.count("*").alias("n"), F.count_if(F.col("district") == "ASIA").alias("a")), "year", "left").crossJoin(F.broadcast(all_))  # a single row
    n, a = F.coalesce("n", F.lit(0)), F.coalesce("a", F.lit(0))
    return g.select("year", n.alias("n"), F.round(100.0 * F.try_divide(n, F.col("n_all")), 4).alias("share"), F.round(100.0 * F.try_divide(a, F.col("n_asia")), 4).alias("share_asia"))


@query(""", t AS (SELECT id, year, spend * (0.98 + (id % 7) * 0.03) AS tot FROM wide), s AS (SELECT id, year, sum(value) AS sec, count(*) AS n FROM sections GROUP BY 1, 2), j AS (SELECT year, tot, sec, n, sec > tot * 1.01 AS anomaly FROM t JOIN s USING (id, year))
 SELECT year, count(*) AS n, round(avg(n) FILTER (NOT anomaly), 4) AS sections, round(100 * sum(greatest(tot - sec, 0)) FILTER (NOT anomaly) / sum(tot) FILTER (NOT anomaly), 4) AS hidden, count(*) FILTER (NOT anomaly AND (tot - sec) / tot > 0.1) AS much, count(*) FILTER (anomaly) AS anomalies FROM j GROUP BY 1""")
def hidden_share(d):
    """What totals hold beyond their sections; totals below their sections are anomalies and not counted."""
    t = d.wide().select("id", "year", (F.col("spend") * (0.98 + (F.col("id") % 7) * 0.03)).alias("tot"))
    s = d.sections().groupBy("id", "year").agg(F.sum("value").alias("sec"), F.count("*").alias("n"))
    j = t.join(s, ["id", "year"]).withColumn("anomaly", F.col("sec") > F.col("tot") * 1.01)
    fine = lambda c: F.when(~F.col("anomaly"), c)
    rest = F.col("tot") - F.col("sec")
    return j.groupBy("year").agg(F.count("*").alias("n"), F.round(F.avg(fine(F.col("n"))), 4).alias("sections"), F.round(100 * F.try_divide(F.sum(fine(F.greatest(rest, F.lit(0.0)))), F.sum(fine(F.col("tot")))), 4).alias("hidden"), F.count_if(~F.col("anomaly") & (F.try_divide(rest, F.col("tot")) > 0.1)).alias("much"), F.count_if("anomaly").alias("anomalies"))


@query("""SELECT region, """ + ", ".join(f"CASE WHEN s{y} < 60 THEN s{y} END AS y{y}" for y in (1996, 1997, 1998)) + " FROM (SELECT region, " + ", ".join(f"round(100.0 * count(DISTINCT w.id) FILTER (year = {y} AND n_orders > 1) / count(DISTINCT e.id)) AS s{y}" for y in (1996, 1997, 1998)) + " FROM entities e LEFT JOIN wide w USING (id) GROUP BY 1)")
def region_year_gaps(d):
    """Per cent of a region's entities with a value in each of three years, where below 60."""
    e = d.entities().select("id", "region")
    size = e.groupBy("region").agg(F.count("*").alias("size"))
    have = d.wide().filter("n_orders > 1").join(e, "id").groupBy("region").pivot("year", [1996, 1997, 1998]).agg(F.count("id"))
    share = lambda y: F.round(100.0 * F.coalesce(F.col(str(y)), F.lit(0)) / F.col("size"))
    return size.join(have, "region", "left").select("region", *[F.when(share(y) < 60, share(y)).alias(f"y{y}") for y in (1996, 1997, 1998)])


@query("""SELECT year, round(quantile_cont(spend, 0.5), 4) AS p50, round(quantile_cont(spend, 0.9), 4) AS p90, round(avg(spend), 4) AS mean, round(max(spend), 4) AS top FROM wide GROUP BY 1""")
def value_quantiles(d):
    q = F.percentile("spend", F.array(F.lit(0.5), F.lit(0.9)))
    g = d.wide().groupBy("year").agg(q.alias("q"), F.avg("spend").alias("mean"), F.max("spend").alias("top"))
    return g.select("year", F.round(F.get("q", F.lit(0)), 4).alias("p50"), F.round(F.get("q", F.lit(1)), 4).alias("p90"), F.round("mean", 4).alias("mean"), F.round("top", 4).alias("top"))


_INDEX = "SELECT p_brand AS method, CAST(2 + p_size % 9 AS BIGINT) AS k, CAST(p_partkey % 11 AS DOUBLE) AS sil, CAST(p_size % 3 AS DOUBLE) AS ch, CASE WHEN p_size % 9 = 4 THEN NULL ELSE CAST(p_partkey % 5 AS DOUBLE) END AS sdbw FROM part"


@query(f"""WITH tab AS ({_INDEX}), t AS (SELECT method, k, avg(sil) AS sil, avg(ch) AS ch, avg(sdbw) AS sdbw FROM tab GROUP BY 1, 2),
 r AS (SELECT method, k, """ + ", ".join(f"CASE WHEN {c} IS NOT NULL THEN rank() OVER (PARTITION BY method ORDER BY {c} {o} NULLS LAST) + (count(*) OVER (PARTITION BY method, {c}) - 1) / 2.0 END AS {c}" for c, o in (("sil", "DESC"), ("ch", "DESC"), ("sdbw", "ASC"))) + """ FROM t)
 SELECT method, k, round((coalesce(sil, 0) + coalesce(ch, 0) + coalesce(sdbw, 0)) / ((sil IS NOT NULL)::INT + (ch IS NOT NULL)::INT + (sdbw IS NOT NULL)::INT), 6) AS rank FROM r""", views=False)
def consensus_k(d):
    """Mean place of each number of clusters over the indices, of made index values."""
    size, key = F.col("p_size"), F.col("p_partkey")
    tab = d.part.select(F.col("p_brand").alias("method"), (2 + size % 9).cast("long").alias("k"), (key % 11).cast("double").alias("sil"), (size % 3).cast("double").alias("ch"), F.when(size % 9 != 4, (key % 5).cast("double")).alias("sdbw"))
    return R.consensus(tab, {"sil": True, "ch": True, "sdbw": False}).select("method", "k", F.round("rank", 6).alias("rank"))


@query("SELECT region, district, count(*) AS n FROM entities GROUP BY 1, 2")
def regions_table(d):
    return d.entities().groupBy("region", "district").agg(F.count("*").alias("n"))


_Z = ", fl AS (SELECT label, feature, v FROM (SELECT label, x0, x1, x2, x3, x4 FROM features) UNPIVOT (v FOR feature IN (x0, x1, x2, x3, x4))), mz AS (SELECT feature, avg(v) AS m, stddev_pop(v) AS s FROM fl GROUP BY 1), z AS (SELECT label, feature, round(3 * avg((v - m) / nullif(s, 0)), 6) AS z FROM fl JOIN mz USING (feature) GROUP BY 1, 2), rz AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY abs(z) DESC, feature) AS place, count(*) FILTER (abs(z) >= 0.5) OVER (PARTITION BY label) AS strong FROM z), ch AS (SELECT label, feature, z, place, CASE WHEN z >= 1.5 THEN 'max' WHEN z >= 0.5 THEN 'high' WHEN z > -0.5 THEN 'mid' WHEN z > -1.5 THEN 'low' ELSE 'min' END AS category FROM rz WHERE place <= CASE WHEN strong >= 3 THEN least(strong, 5) ELSE 3 END)"


def _chosen(d):
    f = d.features().unpivot(["label"], [f"x{i}" for i in range(5)], "feature", "v")
    m = f.groupBy("feature").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    z = f.join(F.broadcast(m), "feature").groupBy("label", "feature").agg(F.round(3 * F.avg(F.try_divide(F.col("v") - F.col("m"), F.col("s"))), 6).alias("z"))  # a row a feature
    v = F.col("z")
    return R.strongest(z).withColumn("category", F.when(v >= 1.5, "max").when(v >= 0.5, "high").when(v > -0.5, "mid").when(v > -1.5, "low").otherwise("min"))


@query(_Z + "SELECT label, feature, z, place FROM ch")
def strongest_features(d):
    return _chosen(d).select("label", "feature", "z", F.col("place").cast("long").alias("place"))


@query(_Z + ", g AS (SELECT label, category, string_agg(feature, ', ' ORDER BY place) AS f FROM ch GROUP BY 1, 2) SELECT label, string_agg(CASE category " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in R.PHRASES.items()) + " END || ': ' || f || '.', ' ' ORDER BY CASE category " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(R.PHRASES)) + " END) AS text FROM g GROUP BY 1")
def cluster_text(d):
    """A description of each cluster."""
    return R.describe(_chosen(d))


_SERIES = ", st AS (SELECT *, CASE WHEN id % 5 > 0 THEN id % 3 = 0 END AS valid, id % 7 = 0 AS derived FROM wide)"


@query(_SERIES + "SELECT id, year, spend FROM st WHERE (coalesce(valid, FALSE) OR derived) AND id IN (SELECT id FROM entities WHERE kind <> 'MACHINERY')")
def series_load(d):
    """Valid or derived values of the entities that count."""
    valid = F.when(F.col("id") % 5 > 0, F.col("id") % 3 == 0)
    active = d.entities().filter("kind <> 'MACHINERY'").select("id")
    return d.wide().filter(F.coalesce(valid, F.lit(False)) | (F.col("id") % 7 == 0)).join(active, "id", "left_semi").select("id", "year", "spend")


@query("SELECT event_id, CASE WHEN y BETWEEN 1990 AND 2035 THEN y END AS year FROM (SELECT event_id, TRY_CAST(nullif(regexp_extract(t, '(\\d{4})', 1), '') AS BIGINT) AS y FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'за ' || (1980 + event_id % 70) || ' год' WHEN 1 THEN 'n/a' WHEN 2 THEN '31.12.' || (2000 + event_id % 30) ELSE NULL END AS t FROM events))", views=False)
def year_of_text(d):
    """The first four digits of a heading, if they are a year from 1990 to 2035."""
    e, k = F.col("event_id"), F.col("event_id") % 4
    t = F.when(k == 0, F.concat(F.lit("за "), (1980 + e % 70).cast("string"), F.lit(" год"))).when(k == 1, "n/a").when(k == 2, F.concat(F.lit("31.12."), (2000 + e % 30).cast("string")))
    y = F.expr("try_cast(nullif(regexp_extract(t, '([0-9]{4})', 1), '') AS BIGINT)")
    return d.events.select("event_id", t.alias("t")).select("event_id", F.when(y.between(1990, 2035), y).alias("year"))


@query("SELECT id, year, 'basic' AS method, 1.0 * spend AS v FROM wide UNION ALL SELECT id, year, 'wide', spend * 1.1 FROM wide WHERE FALSE UNION ALL SELECT id, year, 'sectoral', CAST(n_orders AS DOUBLE) FROM wide")
def replaced_methods(d):
    """Rows of methods that were computed again take the place of the old ones."""
    old = d.wide().select("id", "year", F.explode(F.array(F.lit("basic"), F.lit("sectoral"))).alias("method"), F.col("spend").alias("v"))
    new = d.wide().select("id", "year", F.lit("sectoral").alias("method"), F.col("n_orders").cast("double").alias("v"))
    done = new.select("method").distinct()
    return old.join(F.broadcast(done), "method", "left_anti").unionByName(new)  # a row a method


@query(", va(variant, extra) AS (VALUES ('base', 0.0), ('low', -0.1), ('high', 0.1)), b AS (SELECT variant, id, w.year, region, spend * (1 + extra * (id % 2)) AS base FROM wide w JOIN entities USING (id) CROSS JOIN va) SELECT variant, id, year, round(total * base / sum(base) OVER (PARTITION BY variant, region, year), 4) AS v FROM b JOIN regional USING (region, year)")
def allocation_variants(d):
    """The allocation of regional totals under three settings, all in one plan."""
    va = d.spark.sql("SELECT * FROM VALUES ('base', 0.0D), ('low', -0.1D), ('high', 0.1D) AS t(variant, extra)")
    b = d.wide().join(d.entities().select("id", "region"), "id").crossJoin(F.broadcast(va)).withColumn("base", F.col("spend") * (1 + F.col("extra") * (F.col("id") % 2)))  # three rows
    whole = b.groupBy("variant", "region", "year").agg(F.sum("base").alias("whole")).join(d.regional(), ["region", "year"])
    return b.join(whole, ["variant", "region", "year"]).select("variant", "id", "year", F.round(F.try_divide(F.col("total") * F.col("base"), F.col("whole")), 4).alias("v"))


@query("SELECT flag, CASE WHEN idx > 100 THEN 'up' ELSE 'down' END AS kind, count(*) AS n FROM price_index GROUP BY 1, 2")
def deflator_counts(d):
    return d.price_index().groupBy("flag", F.when(F.col("idx") > 100, "up").otherwise("down").alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT p_partkey AS id, array_to_string(list_filter(list_distinct_ordered, lambda x: x IN ('a', 'c', 'd')), ',') AS features FROM (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN ['a', 'b', 'c', 'd'] ELSE ['c', 'a', 'd', 'b'] END AS list_distinct_ordered FROM part)", views=False)
def feature_list(d):
    """Features of several lists in their order, each once, that the registry knows."""
    one = F.when(F.col("p_size") % 2 == 0, F.array(*map(F.lit, "abc"))).otherwise(F.array(*map(F.lit, "ca")))
    known = F.array(*map(F.lit, "acd"))
    two = F.when(F.col("p_size") % 2 == 0, F.array(*map(F.lit, "bd"))).otherwise(F.array(*map(F.lit, "dab")))
    return d.part.select(F.col("p_partkey").alias("id"), F.array_join(F.array_intersect(F.array_distinct(F.concat(one, two)), known), ",").alias("features"))
