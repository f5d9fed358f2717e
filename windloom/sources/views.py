"""Field views: the tables of a data folder seen as gridded fields, series, calendars and runs.

Cells are the canonical layout: s (slice), level, y, x, u, v. A slice is one plane of a field.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Side of the planes that vectors of 64 numbers make.
SIDE = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """s, level, u, v (arrays, row-major in y, x): even vectors are u, the next odd ones v."""
    e = table(spark, sf_dir, "embeddings")
    s = F.floor(F.col("vec_id") / 2).cast("long")
    even = e.where("vec_id % 2 = 0").select(s.alias("s"), F.col("label").alias("level"), F.col("embedding").cast("array<double>").alias("u"))
    odd = e.where("vec_id % 2 = 1").select(s.alias("s"), F.col("embedding").cast("array<double>").alias("v"))
    return even.join(odd, "s")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("i")
    flat = slices(spark, sf_dir).select("s", "level", F.posexplode(F.arrays_zip("u", "v")).alias("i", "c"))
    return flat.select("s", "level", F.floor(i / SIDE).cast("int").alias("y"), (i % SIDE).cast("int").alias("x"), F.col("c.u").alias("u"), F.col("c.v").alias("v"))


CELLS_SQL = """cells as (
  select s, level, cast(i // 8 as integer) as y, cast(i % 8 as integer) as x, cast(u[i + 1] as double) as u, cast(v[i + 1] as double) as v
  from (select e.vec_id // 2 as s, e.label as level, e.embedding as u, o.embedding as v, unnest(range(64)) as i
        from embeddings e join embeddings o on o.vec_id = e.vec_id + 1 where e.vec_id % 2 = 0))"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """level, u, v, part (A pred, R ref, N other), seed, time."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_linenumber").alias("level"), F.col("l_extendedprice").alias("u"), F.col("l_quantity").alias("v"), F.col("l_returnflag").alias("part"), F.col("l_linestatus").alias("seed"), F.col("l_shipdate").alias("time")
    )


SAMPLES_SQL = "samples as (select l_linenumber as level, l_extendedprice as u, l_quantity as v, l_returnflag as part, l_linestatus as seed, l_shipdate as time from lineitem)"


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly series by event type: series, time (whole hour), u (mean value), v (number of events)."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("series"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("time")).agg(F.avg("value").alias("u"), F.count("*").cast("double").alias("v"))


HOURLY_SQL = "hourly as (select event_type as series, date_trunc('hour', ts) as time, avg(value) as u, cast(count(*) as double) as v from events group by 1, 2)"


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct order days and their mean price."""
    return table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.avg("o_totalprice").alias("u"), F.count("*").alias("n"))


CALENDAR_SQL = "calendar as (select cast(o_orderdate as date) as day, avg(o_totalprice) as u, count(*) as n from orders group by 1)"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Condition keys (month, day, hour, seed) and a cost, one row for each supplier."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("run"), (1 + 3 * (k % 4)).alias("month"), (8 + k % 7).alias("day"), (12 * (k % 2)).alias("hour"), (k % 3).alias("seed"), F.col("s_acctbal").alias("seconds"), F.when(k % 5 != 0, F.col("s_acctbal") / 2).otherwise(F.lit(float("nan"))).alias("memory"))


RUNS_SQL = "runs as (select s_suppkey as run, 1 + 3 * (s_suppkey % 4) as month, 8 + s_suppkey % 7 as day, 12 * (s_suppkey % 2) as hour, s_suppkey % 3 as seed, s_acctbal as seconds, case when s_suppkey % 5 <> 0 then s_acctbal / 2 else 'nan'::double end as memory from supplier)"
