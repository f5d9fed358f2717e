"""Queries on condition runs, shared grids, floors, anchors and ingestion.

The planes are seen as condition runs: a slice's number gives its month, day, hour and seed.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from windloom.operators import conditions, ensemble
from windloom.plans.base import query, rounded
from windloom.plans.distribution_queries import _QS
from windloom.sources import ingest
from windloom.sources.views import CELLS_SQL, cells, samples, slices, table

KEYS = "1 + 3 * (s % 4) as month, 8 + s // 4 % 7 as day, 12 * (s // 28 % 2) as hour, s // 56 % 3 as seed"
RUNS_SQL = f"{CELLS_SQL}, runs as (select *, {KEYS} from cells)"


def condition_cells(spark, d):
    s = F.col("s")
    return cells(spark, d).withColumns({"month": 1 + 3 * (s % 4), "day": 8 + F.floor(s / 4) % 7, "hour": 12 * (F.floor(s / 28) % 2), "seed": F.floor(s / 56) % 3})


@query(f"with {CELLS_SQL} select cast(level as bigint) as level, count(*) as n, round(sum(u), 5) as total from cells where level between 2 and 5 group by level")
def level_band(spark, d):
    return rounded(conditions.level_band(cells(spark, d), 2, 5).groupBy("level").agg(F.count("*").alias("n"), F.sum("u").alias("total")), 5)


@query(f"with {RUNS_SQL} select cast(y - 2 as bigint) as y, cast(x - 2 as bigint) as x, round(avg(u), 6) as u, count(*) as n from runs where y between 2 and 5 and x between 2 and 5 and month = 4 and hour = 0 and day in (8, 9, 10) group by 1, 2")
def centre_window(spark, d):
    w = conditions.centre_window(condition_cells(spark, d), 4).where("month = 4 and hour = 0 and day in (8, 9, 10)")
    return rounded(w.groupBy("y", "x").agg(F.avg("u").alias("u"), F.count("*").alias("n")))


@query(f"with {RUNS_SQL}, a as (select * from runs where seed < 2 and level < 8), b as (select * from runs where month <> 10 and level > 1) select month, day, hour, seed, count(*) as n, round(sum(u), 5) as total from a where level in (select level from b) and (month, day, hour, seed) in (select month, day, hour, seed from b) group by 1, 2, 3, 4")
def common_runs(spark, d):
    r = condition_cells(spark, d)
    a, _ = conditions.on_common(r.where("seed < 2 and level < 8"), r.where("month <> 10 and level > 1"))
    return rounded(a.groupBy(*conditions.CONDITION).agg(F.count("*").alias("n"), F.sum("u").alias("total")), 5)


def _floor_sql(c: str) -> str:
    side = lambda op: f"(select month(time) as m, hour(time) as h, level, unnest(quantile_cont({c}, {_QS})) as x, unnest(range(1024)) as i from s where day(time) {op} 11 group by 1, 2, 3)"
    return f"select m, h, avg(abs(a.x - b.x)) as w from {side('<')} a join {side('>=')} b using (m, h, level, i) group by m, h, level"


@query(f"with s as (select l_linenumber as level, l_extendedprice as u, l_quantity as v, l_shipdate as time from lineitem where day(l_shipdate) between 8 and 14 and l_linenumber <= 3) select round(avg(w), 4) as w1, count(*) as groups from (select m, h, avg(w) as w from ({_floor_sql('u')} union all {_floor_sql('v')}) group by m, h)")
def condition_floor(spark, d):
    from windloom.operators import distributions
    from windloom.operators.aggregate import held_out_days

    s = held_out_days(samples(spark, d).where("level <= 3"), "time")
    return rounded(distributions.conditional_w1(*conditions.floor_groups(s), ["month", "hour"]), 4)


@query(f"""with {RUNS_SQL}, one as (select month, day, hour, seed, y, x, avg(u) as u, avg(v) as v from runs group by all),
 g as (select a.month, a.day, a.hour, sqrt(avg((a.u - b.u) ** 2 + (a.v - b.v) ** 2)) as rms from one a join one b on a.month = b.month and a.day = b.day and a.hour = b.hour and a.y = b.y and a.x = b.x and a.seed < b.seed group by a.month, a.day, a.hour, a.seed, b.seed),
 ref as (select month, day, hour, y, x, avg(u) as u, avg(v) as v from runs where seed = 0 group by all),
 o as (select sqrt(avg((a.u - b.u) ** 2 + (a.v - b.v) ** 2)) as rms from ref a join ref b on a.month = b.month and a.hour = b.hour and a.y = b.y and a.x = b.x and a.day < b.day group by a.month, a.hour, a.day, b.day)
 select round((select avg(rms) from g) / (select avg(rms) from o), 6) as ratio, round((select avg(rms) from g), 6) as generated, round((select avg(rms) from o), 6) as observed""")
def ensemble_spread_ratio(spark, d):
    r = condition_cells(spark, d)
    one = r.groupBy(*conditions.CONDITION, "y", "x").agg(F.avg("u").alias("u"), F.avg("v").alias("v"))
    ref = r.where("seed = 0").groupBy("month", "day", "hour", "y", "x").agg(F.avg("u").alias("u"), F.avg("v").alias("v"))
    return rounded(ensemble.spread_ratio(one, ref, ["month", "hour"], "seed", "day", ["y", "x"]))


@query(f"with {CELLS_SQL}, p as (select s, level, avg(u) as mu, stddev_pop(u) as su from cells group by 1, 2) select round(sum(0.5 * ln(2 * pi()) + ln(su + 0.01) + 0.5 * ((u - mu) / (su + 0.01)) ** 2), 3) as nlpd, round(avg(sqrt((u - mu) ** 2 + (v - mu) ** 2)), 6) as residual from cells join p using (s, level)")
def predictive_density(spark, d):
    c = cells(spark, d)
    p = c.groupBy("s", "level").agg(F.avg("u").alias("mu"), F.stddev_pop("u").alias("su"))
    j, m = c.join(p, ["s", "level"]), F.col("mu")
    got = j.agg(conditions.negative_log_density(F.col("u"), m, F.col("su") + 0.01).alias("nlpd"), F.avg(conditions.residual(F.col("u"), F.col("v"), m, m)).alias("residual"))
    return got.select(F.round("nlpd", 3).alias("nlpd"), F.round("residual", 6).alias("residual"))


@query(f"with {CELLS_SQL}, j as (select *, sqrt((lead(u) over w - u) ** 2 + (lead(v) over w - v) ** 2) as jump from cells window w as (partition by s, y order by x)) select round(avg(jump) filter (x = 3) / greatest(avg(jump), 1e-12), 6) as ratio from j where jump is not null")
def fixed_seam(spark, d):
    return rounded(conditions.seam_at(cells(spark, d), ["s"], "x", 3))


@query(f"with {CELLS_SQL} select s, cast(y as bigint) as y, cast(x as bigint) as x, 25 + 0.25 * (32 + y)::double as lat, 225 + 0.25 * (32 + x)::double as lon, strftime(timestamp '2023-01-15' + to_hours(cast(2 + s % 4 as integer)), '%Y-%m-%d %H') as hour from cells")
def attached_coordinates(spark, d):
    c = conditions.attach_coordinates(cells(spark, d).withColumn("t", F.col("s") % 4), 25.0, 225.0, "2023-01-15 00:00:00", 32, 2)
    return rounded(c.select("s", "y", "x", "lat", "lon", F.date_format("time", "yyyy-MM-dd HH").alias("hour")))


@query("select s_suppkey, cast(coalesce(case when s_suppkey % 3 = 0 then s_suppkey * 10 end, s_suppkey * (2 * 18 - 1)) as bigint) as forwards from supplier")
def forward_counts(spark, d):
    r = table(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 3 == 0, F.col("s_suppkey") * 10).alias("forwards"), F.col("s_suppkey").alias("calls"), F.lit(18).alias("steps"))
    return rounded(conditions.forwards(r).select("s_suppkey", "forwards"))


@query("select cast(k as bigint) as k, round(exp(ln(130.0) + k * (ln(60.0) - ln(130.0)) / 9), 6) as hpa from (select unnest(range(10)) as k)")
def pressure_levels(spark, d):
    return rounded(ingest.pressure_levels(spark, list(conditions.SHARED_HPA), 10))


@query("with p as (select s_suppkey, 30 + s_suppkey % 20 as lat, -130 + s_suppkey % 30 as lon from supplier) select s_suppkey, round((lat - 37.5) / 12.5, 6)::double as lat_n, round((lon + 360 - 240) / 15.0, 6)::double as lon_n from p")
def coordinate_channels(spark, d):
    p = table(spark, d, "supplier").select("s_suppkey", (30 + F.col("s_suppkey") % 20).alias("lat"), (F.col("s_suppkey") % 30 - 130).alias("lon"))
    grid = spark.createDataFrame([(25.0, 225.0), (50.0, 255.0)], "lat double, lon double")
    return rounded(ingest.coordinate_channels(p, grid).select("s_suppkey", "lat_n", "lon_n"))


@query()
def field_payload(spark, d):
    return ingest.field_payload(cells(spark, d).withColumn("t", F.lit(0)), ["s"], 8, 4)


@query()
def demo_cache(spark, d):
    return rounded(ingest.demo_cache(spark, (12, 10), 8, seed=3))


@query()
def anchor_fields(spark, d):
    return rounded(conditions.anchors(slices(spark, d), cells(spark, d), 8, 8))


@query()
def shared_grid(spark, d):
    """The planes' columns on 5 x 5 points and at three pressures: levels are pressures of 100 hPa a number."""
    c = cells(spark, d).withColumn("run", F.floor(F.col("s") / 40)).groupBy("run", "level", "y", "x").agg(F.avg("u").alias("u"), F.avg("v").alias("v"))
    whole = c.select("run", "level").distinct().groupBy("run").agg(F.min("level").alias("lo"), F.max("level").alias("hi")).where("lo <= 3 and hi >= 6")
    pressure = spark.range(20).select(F.col("id").cast("int").alias("level"), (100.0 * F.col("id")).alias("p"))
    at = [30.5 + 1.25 * k for k in range(5)]
    got = conditions.to_shared_grid(c.join(whole.select("run"), "run"), ["run"], (30.0, 1.0, 8), (230.0, 1.0, 8), at, [x + 200 for x in at], pressure, 80.0, (350.0, 425.0, 550.0), 100.0)
    return rounded(got)


@query()
def run_metrics(spark, d):
    c = cells(spark, d).withColumn("t", F.col("s").cast("int")).withColumn("level", F.lit(0))
    p = slices(spark, d).withColumn("t", F.col("s").cast("int")).withColumn("level", F.lit(0))
    return rounded(conditions.field_metrics(c, p, 8, 8, (3, 3, 1)))


@query()
def floor_board(spark, d):
    """The held-out days' halves against each other, all metrics that need no time."""
    from windloom.operators.aggregate import held_out_days

    return rounded(conditions.floor(held_out_days(samples(spark, d).where("level <= 2"), "time")), 4)


@query()
def field_descriptors(spark, d):
    from windloom.operators import spectra

    return rounded(spectra.field_diagnostics(slices(spark, d), ["s"], 8, 8))


@query()
def shared_board(spark, d):
    """Two methods (seeds 0 and 1) against a reference (seed 2) under equal conditions."""
    r = condition_cells(spark, d)
    full = [r.where(F.col("seed") == k).withColumn("seed", F.lit(0)) for k in range(3)]
    from windloom.operators import align

    keys = align.common_keys(full, list(conditions.CONDITION))
    full = [f.join(F.broadcast(keys), list(conditions.CONDITION), "left_semi") for f in full]  # at most 56 conditions
    return rounded(conditions.score_board(full[2], {"a": full[0], "b": full[1]}), 5)
