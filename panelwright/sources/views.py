"""The star-schema tables as panel tables: entities, long panel, sections, prices, regional totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Data:
    """The tables of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def entities(self) -> DataFrame:
        """``id, region, district, kind, name``; nations and regions are of a fixed size."""
        nr = self.nation.join(F.broadcast(self.region), F.col("n_regionkey") == F.col("r_regionkey"))
        c = self.customer.join(F.broadcast(nr), F.col("c_nationkey") == F.col("n_nationkey"))
        return c.select(F.col("c_custkey").alias("id"), F.col("n_nationkey").cast("long").alias("region"), F.col("r_name").alias("district"), F.col("c_mktsegment").alias("kind"), F.col("c_name").alias("name"))

    def wide(self) -> DataFrame:
        """``id, year, spend, n_orders``."""
        o = self.orders.select(F.col("o_custkey").alias("id"), F.year("o_orderdate").cast("long").alias("year"), "o_totalprice")
        return o.groupBy("id", "year").agg(F.round(F.sum("o_totalprice"), 4).alias("spend"), F.count("*").alias("n_orders"))

    def long(self) -> DataFrame:
        w = self.wide().select("id", "year", "spend", F.col("n_orders").cast("double").alias("n_orders"))
        return w.unpivot(["id", "year"], ["spend", "n_orders"], "indicator", "value").filter("value is not null")

    def sections(self) -> DataFrame:
        """``id, year, section, value``: spend by the first character of the priority."""
        o = self.orders.select(F.col("o_custkey").alias("id"), F.year("o_orderdate").cast("long").alias("year"), F.substring("o_orderpriority", 1, 1).alias("section"), "o_totalprice")
        return o.groupBy("id", "year", "section").agg(F.round(F.sum("o_totalprice"), 4).alias("value"))

    def regional(self) -> DataFrame:
        """``region, year, total``: revenue of suppliers by the year shipped."""
        l = self.lineitem.select("l_suppkey", F.year("l_shipdate").cast("long").alias("year"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"))
        l = l.groupBy("l_suppkey", "year").agg(F.sum("v").alias("v"))
        s = self.supplier.select("s_suppkey", F.col("s_nationkey").cast("long").alias("region"))
        return l.join(s, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("region", "year").agg(F.round(F.sum("v"), 4).alias("total"))

    def price_index(self) -> DataFrame:
        """``flag, year, idx``: mean unit price by return flag as per cent of the year before."""
        from pyspark.sql import Window as W

        p = self.lineitem.groupBy(F.col("l_returnflag").alias("flag"), F.year("l_shipdate").cast("long").alias("year")).agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("p"))
        lag = F.lag("p").over(W.partitionBy("flag").orderBy("year"))
        return p.select("flag", "year", F.round(100 * F.try_divide(F.col("p"), lag), 6).alias("idx")).filter("idx is not null")

    def features(self, dims: int = 5) -> DataFrame:
        """``year, id, x0..``: vectors, with the label's remainder of 2 as the year."""
        e = self.embeddings
        return e.select((F.col("label") % 2).cast("long").alias("year"), F.col("vec_id").alias("id"), F.col("label").cast("long").alias("label"), *[F.round(F.get("embedding", F.lit(i)).cast("double"), 6).alias(f"x{i}") for i in range(dims)])

    def types(self, n: int = 5) -> DataFrame:
        """``id, year, label``: fifths of the yearly spend; 0 is the highest. A window a year."""
        from pyspark.sql import Window as W

        w = W.partitionBy("year").orderBy(F.desc("spend"), "id")
        return self.wide().select("id", "year", (F.ntile(n).over(w) - 1).cast("long").alias("label"))


#: The same views in SQL, to put before a query.
SQL = """
WITH entities AS (
  SELECT c_custkey AS id, CAST(n_nationkey AS BIGINT) AS region, r_name AS district, c_mktsegment AS kind, c_name AS name
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
), wide AS (
  SELECT o_custkey AS id, CAST(year(o_orderdate) AS BIGINT) AS year, round(sum(o_totalprice), 4) AS spend, CAST(count(*) AS BIGINT) AS n_orders
  FROM orders GROUP BY 1, 2
), long AS (
  SELECT id, year, 'spend' AS indicator, spend AS value FROM wide
  UNION ALL SELECT id, year, 'n_orders', CAST(n_orders AS DOUBLE) FROM wide
), sections AS (
  SELECT o_custkey AS id, CAST(year(o_orderdate) AS BIGINT) AS year, substr(o_orderpriority, 1, 1) AS section, round(sum(o_totalprice), 4) AS value
  FROM orders GROUP BY 1, 2, 3
), regional AS (
  SELECT CAST(s_nationkey AS BIGINT) AS region, CAST(year(l_shipdate) AS BIGINT) AS year, round(sum(l_extendedprice * (1 - l_discount)), 4) AS total
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2
), unit_price AS (
  SELECT l_returnflag AS flag, CAST(year(l_shipdate) AS BIGINT) AS year, avg(l_extendedprice / l_quantity) AS p FROM lineitem GROUP BY 1, 2
), price_index AS (
  SELECT flag, year, idx FROM (SELECT flag, year, round(100 * p / nullif(lag(p) OVER (PARTITION BY flag ORDER BY year), 0), 6) AS idx FROM unit_price) WHERE idx IS NOT NULL
), features AS (
  SELECT CAST(label % 2 AS BIGINT) AS year, vec_id AS id, CAST(label AS BIGINT) AS label,
    round(CAST(embedding[1] AS DOUBLE), 6) AS x0, round(CAST(embedding[2] AS DOUBLE), 6) AS x1, round(CAST(embedding[3] AS DOUBLE), 6) AS x2,
    round(CAST(embedding[4] AS DOUBLE), 6) AS x3, round(CAST(embedding[5] AS DOUBLE), 6) AS x4
  FROM embeddings
), types AS (
  SELECT id, year, CAST(ntile(5) OVER (PARTITION BY year ORDER BY spend DESC, id) - 1 AS BIGINT) AS label FROM wide
)
"""
