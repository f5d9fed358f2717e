"""Queries on distributions, aggregates and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from windloom.functions.noise import derived_seed
from windloom.operators import aggregate, align, arena, boards, distributions
from windloom.plans.base import query, rounded
from windloom.plans.spectral_sql import WINDOWED_SQL
from windloom.sources.views import CALENDAR_SQL, CELLS_SQL, RUNS_SQL, SAMPLES_SQL, calendar, cells, runs, samples, slices, table

#: SQL for the 1024 quantiles of a column by level of one part.
_QS = "[i / 1023.0::double for i in range(1024)]"
_LEVEL = "dense_rank() over (order by level) - 1"


def _w1_sql(c: str) -> str:
    return f"""select '{c}' as component, round(avg(w), 4) as w1 from (
  select a.k, avg(abs(a.x - b.x)) as w from
    (select {_LEVEL} as k, unnest(q) as x, unnest(range(1024)) as i from (select level, quantile_cont({c}, {_QS}) as q from samples where part = 'A' group by level)) a
    join (select {_LEVEL} as k, unnest(q) as x, unnest(range(1024)) as i from (select level, quantile_cont({c}, {_QS}) as q from samples where part = 'R' group by level)) b on a.k = b.k and a.i = b.i group by a.k)"""


W1_SQL = f"with {SAMPLES_SQL} {_w1_sql('u')} union all {_w1_sql('v')}"


@query(W1_SQL)
def marginal_w1(spark, d):
    s = samples(spark, d)
    return rounded(distributions.marginal_w1(s.where("part = 'A'"), s.where("part = 'R'")), 4)


@query(f"""with {SAMPLES_SQL}, e as (select level, avg(abs(a.x - b.x)) as w from (select level, unnest(quantile_cont(u, {_QS})) as x, unnest(range(1024)) as i from samples where part = 'A' group by level) a
 join (select level, unnest(quantile_cont(u, {_QS})) as x, unnest(range(1024)) as i from samples where part = 'N' group by level) b using (level, i) group by level) select cast(level as bigint) as level, round(w, 4) as w1 from e""")
def wasserstein1_by_level(spark, d):
    s = samples(spark, d)
    return rounded(distributions.wasserstein1(s.where("part = 'A'"), s.where("part = 'N'"), ["level"], "u"), 4)


@query(f"""with {SAMPLES_SQL}, q as (select level, part, quantile_cont(u, [0.01, 0.99, 0.001, 0.999]) as qu, quantile_cont(v, [0.01, 0.99, 0.001, 0.999]) as qv from samples where part in ('A', 'R') group by 1, 2),
 e as (select a.qu as au, b.qu as bu, a.qv as av, b.qv as bv from q a join q b on a.level = b.level and a.part = 'A' and b.part = 'R'),
 f as (select unnest([(abs(au[1]-bu[1]) + abs(au[2]-bu[2])) / 2, (abs(av[1]-bv[1]) + abs(av[2]-bv[2])) / 2]) as e1, unnest([(abs(au[3]-bu[3]) + abs(au[4]-bu[4])) / 2, (abs(av[3]-bv[3]) + abs(av[4]-bv[4])) / 2]) as e2 from e)
 select '1%' as tail, round(avg(e1), 4) as error from f union all select '0.1%', round(avg(e2), 4) from f""")
def extreme_quantiles(spark, d):
    s = samples(spark, d)
    return rounded(distributions.extreme_quantile_error(s.where("part = 'A'"), s.where("part = 'R'")), 4)


def _cond(c):
    return f"""select m, avg(abs(a.x - b.x)) as w from (select month(time) as m, level, unnest(quantile_cont({c}, {_QS})) as x, unnest(range(1024)) as i from samples where part = 'A' group by 1, 2) a
 join (select month(time) as m, level, unnest(quantile_cont({c}, {_QS})) as x, unnest(range(1024)) as i from samples where part = 'R' group by 1, 2) b using (m, level, i) group by m, level"""


@query(f"with {SAMPLES_SQL} select round(avg(w), 4) as w1, count(*) as groups from (select m, avg(w) as w from ({_cond('u')} union all {_cond('v')}) group by m)")
def conditional_w1(spark, d):
    s = samples(spark, d).withColumn("month", F.month("time"))
    return rounded(distributions.conditional_w1(s.where("part = 'A'"), s.where("part = 'R'"), ["month"]), 4)


def _pooled_shear_sql(c: str) -> str:
    """Differences of neighbouring levels of one order's lines by a fixed thickness, all levels pooled."""
    side = lambda f: f"(select unnest(quantile_cont((x - x1) / (100.0 + 10 * level) * 1000, {_QS})) as q, unnest(range(1024)) as i from (select level, {c} as x, lead({c}) over (partition by o order by level) as x1 from lines where part = '{f}') where x1 is not null)"
    return f"select 'W1 shear {c} ((m/s)/km)' as metric, (select avg(abs(a.q - b.q)) from {side('A')} a join {side('R')} b using (i)) as value"


_BOARD_SQL = f"""with {SAMPLES_SQL}, {WINDOWED_SQL},
 lines as (select l_orderkey as o, l_linenumber as level, min(l_returnflag) as part, avg(l_extendedprice) as u, avg(l_quantity) as v from lineitem group by 1, 2),
 qq as (select level, part, quantile_cont(u, [0.01, 0.99, 0.001, 0.999]) as qu, quantile_cont(v, [0.01, 0.99, 0.001, 0.999]) as qv from samples where part in ('A', 'R') group by 1, 2),
 tails as (select a.qu as au, b.qu as bu, a.qv as av, b.qv as bv from qq a join qq b on a.level = b.level and a.part = 'A' and b.part = 'R'),
 board as (
  select 'SR_' || kind as metric, sqrt(avg(pow(ln(a) - ln(b), 2))) as value from ab group by kind
  union all select 'L_eff (km)', (select 8.0 / max(j + 1) from ab where kind = 'E')
  union all {_pooled_shear_sql('u')} union all {_pooled_shear_sql('v')}
  union all select 'W1 ' || component || ' (m/s)', w1 from ({_w1_sql('u')} union all {_w1_sql('v')})
  union all select 'tail err 1% (m/s)', avg((abs(au[1]-bu[1]) + abs(au[2]-bu[2]) + abs(av[1]-bv[1]) + abs(av[2]-bv[2])) / 4) from tails
  union all select 'tail err 0.1% (m/s)', avg((abs(au[3]-bu[3]) + abs(au[4]-bu[4]) + abs(av[3]-bv[3]) + abs(av[4]-bv[4])) / 4) from tails
  union all select 'W1 cond (m/s)', avg(w) from (select m, avg(w) as w from ({_cond('u')} union all {_cond('v')}) group by m)
  union all select unnest(['SR_time', 'disp log-MSD RMSE', 'final spread ratio']), 'nan'::double)
select metric, round(value, 3)::double as value from board"""


@query(_BOARD_SQL)
def flagship_board(spark, d):
    """The metric suite of two parts of the samples: distributions, shear of lines of one order, conditional distances, and spectra of the planes' halves; the table has no tracks in time."""
    s, p = samples(spark, d), slices(spark, d)
    month = s.withColumn("month", F.month("time"))
    # the least flag of a line is A or R where the least of these places is; numbers are aggregated by hash, strings by sorting
    flag = F.col("l_returnflag")
    place = F.when(flag < "A", 0).when(flag == "A", 1).when(flag < "R", 2).when(flag == "R", 3).when(flag > "R", 4)
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("level"), place.alias("place"), "l_extendedprice", "l_quantity").repartition("o")
    lines = lines.groupBy("o", "level").agg(F.min("place").alias("place"), F.avg("l_extendedprice").alias("u"), F.avg("l_quantity").alias("v"))
    thickness = spark.range(1, 8).select(F.col("id").cast("int").alias("level"), (100.0 + 10 * F.col("id")).alias("dz"))
    side = lambda f: s.where(F.col("part") == f)
    got = boards.run_suite(side("A"), side("R"), planes=(p.where("s % 2 = 0"), p.where("s % 2 = 1")), seeds=(month.where("part = 'A'"), month.where("part = 'R'"), ["month"]), thickness=thickness, column=["o"], shear=tuple(lines.where(F.col("place") == k) for k in (1, 3)))
    # the distances have four digits in the SQL before they get three; DuckDB rounds the product, so that a half is the double's, not its text's
    twice = F.round(F.round("value", 4) * 1000) / 1000
    return rounded(got.select("metric", F.when(F.col("metric").isin("W1 u (m/s)", "W1 v (m/s)"), twice).otherwise(F.col("value")).alias("value")), 3)


@query(f"with {SAMPLES_SQL}, c as (select least(19, cast(floor((v - 0) / 2.5) as bigint)) as bin from samples where v between 0 and 50) select b.i as bin, round(case when n.n is null then 'nan'::double else n.n / ((select count(*) from c) * 2.5) end, 6) as density from (select unnest(range(20)) as i) b left join (select bin, count(*) as n from c group by bin) n on n.bin = b.i")
def histogram_density(spark, d):
    return rounded(distributions.histogram(samples(spark, d), "v", 0.0, 50.0, 20))


_STATS_SQL = f"with {SAMPLES_SQL} select cast(level as bigint) as level, round(avg(u), 4) as mean_u, round(stddev_pop(u) + 1e-6, 4) as std_u, round(avg(v), 4) as mean_v, round(stddev_pop(v) + 1e-6, 4) as std_v from samples group by level"


@query(_STATS_SQL)
def norm_stats(spark, d):
    return rounded(aggregate.norm_stats(samples(spark, d)), 4)


@query(f"with {SAMPLES_SQL}, s as (select level, avg(u) as m, stddev_pop(u) + 1e-6 as d from samples group by level) select cast(x.level as bigint) as level, round(avg((u - m) / d), 4) + 0.0 as mean_z, round(stddev_pop((u - m) / d), 4) as std_z, round(max((u - m) / d), 4) as max_z from samples x join s on x.level = s.level group by x.level")
def normalised_levels(spark, d):
    s = samples(spark, d)
    z = aggregate.normalise(s.select("level", "u", "v"), aggregate.norm_stats(s))
    return rounded(z.groupBy("level").agg(F.avg("u").alias("mean_z"), F.stddev_pop("u").alias("std_z"), F.max("u").alias("max_z")), 4).withColumn("mean_z", F.col("mean_z") + 0.0)


@query(f"with {RUNS_SQL} select cast(month as bigint) as month, count(*) as n, round(avg(seconds), 4) as mean_s, round(quantile_cont(seconds, 0.1), 4) as p10_s, round(quantile_cont(seconds, 0.5), 4) as median_s, round(quantile_cont(seconds, 0.9), 4) as p90_s, round(coalesce(quantile_cont(case when not isnan(memory) then memory end, 0.5), 'nan'::double), 4) as memory from runs group by month")
def performance(spark, d):
    return rounded(aggregate.performance(runs(spark, d), ["month"]), 4)


@query(f"with {RUNS_SQL}, s as (select month, count(*) as n, avg(seconds) as mean, coalesce(stddev_samp(seconds), 0) as sd from runs group by month) select cast(month as bigint) as month, n, round(mean, 4) as mean, round(sd, 4) as sd, round(mean - 1.96 * sd / sqrt(n), 4) as low, round(mean + 1.96 * sd / sqrt(n), 4) as high from s")
def normal_interval(spark, d):
    return rounded(aggregate.interval(runs(spark, d), ["month"], "seconds"), 4)


@query()
def bootstrap_interval(spark, d):
    return rounded(aggregate.bootstrap(runs(spark, d), ["month"], "seconds"), 4)


@query(f"with {RUNS_SQL} select cast(month as bigint) as month, cast(day as bigint) as day, round(avg(seconds), 4) as seconds from runs group by 1, 2")
def mean_of_duplicates(spark, d):
    return rounded(aggregate.mean_of_duplicates(runs(spark, d), ["month", "day"], "seconds"), 4)


@query(f"with {RUNS_SQL} select cast(seed as bigint) as seed, round(avg(seconds), 4) as mean_reward, round(stddev_pop(seconds), 4) as std_reward, round(avg(day), 4) as mean_length, round(avg(case when seconds > 0 then 1.0 else 0.0 end), 4) as reach_rate from runs group by seed")
def experiment_summary(spark, d):
    e = runs(spark, d).select("seed", F.col("seconds").alias("reward"), F.col("day").alias("length"), (F.col("seconds") > 0).alias("reached"))
    return rounded(aggregate.experiment_summary(e, ["seed"]), 4)


@query(f"with {CELLS_SQL} select cast(y as bigint) as y, cast(x as bigint) as x, round(avg(sqrt(u*u+v*v)), 6) as mean, round(stddev_pop(sqrt(u*u+v*v)), 6) as std, round(quantile_cont(sqrt(u*u+v*v), 0.95), 6) as p95 from cells group by 1, 2")
def speed_maps(spark, d):
    return rounded(aggregate.speed_maps(cells(spark, d)))


@query(f"with {CELLS_SQL} select round(greatest(quantile_cont(sqrt(u*u+v*v), 0.99), 1), 6) as colour_limit from cells")
def colour_limit(spark, d):
    return rounded(aggregate.colour_limit(cells(spark, d)))


_PMF = "select s.k, coalesce(n, 0) / (select count(*) from {t})::double as p from (select unnest(range(1, 8)) as k) s left join (select l_linenumber as k, count(*) as n from {t} group by 1) using (k)"


@query(f"with a as (select * from lineitem where l_returnflag = 'A'), b as (select * from lineitem where l_returnflag = 'N'), p as ({_PMF.format(t='a')}), q as ({_PMF.format(t='b')}) select round(sum(abs(p.p - q.p)) / 2, 6) as total_variation, round(max(abs(p.p - q.p)), 6) as max_abs, round(sqrt(sum((p.p - q.p) ** 2)), 6) as l2 from p join q using (k)")
def mass_distance(spark, d):
    k = table(spark, d, "lineitem").select(F.col("l_linenumber").cast("long").alias("k"), "l_returnflag")
    support = spark.range(1, 8).withColumnRenamed("id", "k")
    a, b = (aggregate.mass_function(k.where(F.col("l_returnflag") == f), "k", support) for f in "AN")
    return rounded(aggregate.mass_distance(a, b, "k"))


@query(f"with {CELLS_SQL} select round(sqrt(avg((a.u - b.u) ** 2)), 6) as rmse from cells a join cells b on b.s = a.s + 1 and a.y = b.y and a.x = b.x")
def field_rmse(spark, d):
    c = cells(spark, d)
    j = c.select("s", "y", "x", "u").join(c.select((F.col("s") - 1).alias("s"), "y", "x", F.col("u").alias("w")), ["s", "y", "x"])
    return rounded(j.agg(aggregate.field_rmse(F.col("u"), F.col("w")).alias("rmse")))


@query("with a as (select s_suppkey as k, abs(s_acctbal) as cost from supplier), b as (select k, cost * 1.1 as cost from a) select round(sqrt(coalesce(sum((a.cost - b.cost) ** 2), 0) / greatest(count(*), 1)), 4) as rmse, count(*) as n from a join b using (k) where a.cost < 0.99 * 8000 and b.cost < 0.99 * 8000")
def cost_rmse(spark, d):
    a = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.abs("s_acctbal").alias("cost"))
    return rounded(aggregate.cost_rmse(a, a.withColumn("cost", F.col("cost") * 1.1), ["k"], 8000.0), 4)


@query(f"with {CELLS_SQL} select s, cast(level as bigint) as level, cast(y // 2 as bigint) as y, cast(x // 2 as bigint) as x, round(avg(u), 6) as u, round(avg(v), 6) as v from cells group by 1, 2, 3, 4")
def average_pool(spark, d):
    return rounded(aggregate.pooled(cells(spark, d), ["s", "level"], 2, 8))


@query(f"with {CELLS_SQL}, p as (select a.u as a, b.u as b from cells a join cells b on b.s = a.s + 1 and a.y = b.y and a.x = b.x union all select a.v, b.v from cells a join cells b on b.s = a.s + 1 and a.y = b.y and a.x = b.x) select round(sqrt(avg((a-b)**2)), 6) as rmse, round(avg(abs(a-b)), 6) as mae, round(corr(a, b), 6) as r from p")
def pointwise_comparison(spark, d):
    c = cells(spark, d)
    return rounded(aggregate.pointwise(c, c.withColumn("s", F.col("s") - 1), ["s", "y", "x"]))


@query("select count(*) as n, round(sum(o_totalprice), 2) as total, cast(min(day(o_orderdate)) as bigint) as first_day, cast(max(day(o_orderdate)) as bigint) as last_day from orders where day(o_orderdate) between 8 and 14")
def held_out(spark, d):
    o = aggregate.held_out_days(table(spark, d, "orders"), "o_orderdate")
    return rounded(o.agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"), F.min(F.dayofmonth("o_orderdate")).alias("first_day"), F.max(F.dayofmonth("o_orderdate")).alias("last_day")), 2)


@query("select case when day(o_orderdate) < 11 then 'a' else 'b' end as half, count(*) as n, round(avg(o_totalprice), 4) as mean from orders where day(o_orderdate) between 8 and 14 group by 1")
def split_halves(spark, d):
    a, b = aggregate.halves(aggregate.held_out_days(table(spark, d, "orders"), "o_orderdate"), "o_orderdate")
    both = a.withColumn("half", F.lit("a")).unionByName(b.withColumn("half", F.lit("b")))
    return rounded(both.groupBy("half").agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("mean")), 4)


@query("with w as (select unnest(generate_series(timestamp '2024-01-02', timestamp '2024-01-30 23:00:00', interval 1 hour)) as t), h as (select distinct date_trunc('hour', ts) as t from events where event_id % 40 < 11) select issue, count(*) as n, cast(min(t) as varchar) as first_time from (select 'missing' as issue, t from w where t not in (select t from h) union all select 'unexpected', t from h where t not in (select t from w)) group by issue")
def hourly_calendar(spark, d):
    """Hours of a part of the event ids, against a calendar that begins a day later: some are missing, some unexpected."""
    t = table(spark, d, "events").where("event_id % 40 < 11").select(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("time"))
    g = aggregate.hourly_gaps(t, "2024-01-02 00:00:00", "2024-01-31 00:00:00")
    return g.groupBy("issue").agg(F.count("*").alias("n"), F.date_format(F.min("time"), "yyyy-MM-dd HH:mm:ss").alias("first_time"))


@query(f"with {CALENDAR_SQL} select count(*) filter (day(day) between 8 and 14) as leaking, count(*) as days, count(*) filter (year(day) <> 1996) as other_year from calendar")
def leakage_check(spark, d):
    c = calendar(spark, d)
    return rounded(c.agg(F.count_if(F.dayofmonth("day").between(8, 14)).alias("leaking"), F.count("*").alias("days"), F.count_if(F.year("day") != 1996).alias("other_year")))


@query(f"with {RUNS_SQL}, a as (select distinct month, day, hour, seed from runs where run % 2 = 0), b as (select distinct month, day, hour, seed from runs where run % 3 = 0) select 'missing' as side, * from (select * from a except select * from b) union all select 'extra', * from (select * from b except select * from a)")
def condition_set_differences(spark, d):
    r = runs(spark, d)
    return rounded(align.key_differences(r.where("run % 2 = 0"), r.where("run % 3 = 0"), ["month", "day", "hour", "seed"]))


@query(f"with {RUNS_SQL} select * from (select distinct month, day, hour, seed from runs where run % 2 = 0) intersect select * from (select distinct month, day, hour, seed from runs where run % 3 = 0)")
def common_conditions(spark, d):
    r = runs(spark, d)
    return rounded(align.common_keys([r.where("run % 2 = 0"), r.where("run % 3 = 0")], ["month", "day", "hour", "seed"]))


@query(f"with {RUNS_SQL}, done as (select distinct month, day, hour, seed from runs) select m::bigint as month, h::bigint as hour, dd::bigint as day, s::bigint as seed from (select unnest([1, 4, 7, 10]) as m), (select unnest([0, 12]) as h), (select unnest(range(8, 15)) as dd), (select unnest([0, 1]) as s) where (m, h, dd, s) not in (select month, hour, day, seed from done)")
def conditions_to_run(spark, d):
    return rounded(boards.condition_set(spark, [1, 4, 7, 10], [0, 12], range(8, 15), 2, runs(spark, d).select("month", "hour", "day", "seed").distinct()))


@query("select cast(n_nationkey as bigint) as episode, cast(('0x' || substr(sha256('42:' || n_nationkey), 1, 8)) as bigint) as seed from nation")
def derive_seeds(spark, d):
    return rounded(table(spark, d, "nation").select(F.col("n_nationkey").alias("episode"), derived_seed(F.lit(42), F.col("n_nationkey")).alias("seed")))


@query(f"""with {RUNS_SQL}, s as (select 'A' as e, level, u from (select l_linenumber as level, l_extendedprice as u from lineitem where l_returnflag = 'A') union all select 'N', l_linenumber, l_extendedprice from lineitem where l_returnflag = 'N'),
 m as (select e, 'mean' as metric, avg(u) as value from s group by e union all select e, 'p50', quantile_cont(u, 0.5) from s group by e)
 select metric, round(max(case when e = 'A' then value end), 4) as a, round(max(case when e = 'N' then value end), 4) as n from m group by metric""")
def board_pivot(spark, d):
    s = samples(spark, d).where("part in ('A', 'N')").groupBy(F.col("part").alias("entity")).agg(F.avg("u").alias("mean"), F.percentile("u", F.lit(0.5)).alias("p50"))
    long = s.unpivot("entity", ["mean", "p50"], "metric", "value")
    return rounded(boards.pivot(long, ["A", "N"]).withColumnsRenamed({"A": "a", "N": "n"}), 4)


@query("with a as (select o_orderstatus as metric, avg(o_totalprice) as v from orders where day(o_orderdate) < 15 group by 1), b as (select o_orderstatus as metric, avg(o_totalprice) as v from orders where day(o_orderdate) >= 15 group by 1) select metric, round(b.v - a.v, 4) as penalty from a join b using (metric)")
def tiling_penalty(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderstatus").alias("metric"), "o_totalprice", F.dayofmonth("o_orderdate").alias("day"))
    a, b = (o.where(w).groupBy("metric").agg(F.avg("o_totalprice").alias("value")) for w in ("day < 15", "day >= 15"))
    return rounded(boards.tiling_penalty(a, b), 4)


@query(f"with {RUNS_SQL}, e as (select run, seed, row_number() over (partition by seed order by run) - 1 as idx from runs) select cast(seed as bigint) as seed, count(*) as n, max(idx) as last_idx from e group by seed")
def pooled_records(spark, d):
    return rounded(aggregate.ordered(runs(spark, d), ["seed"], "run").groupBy("seed").agg(F.count("*").alias("n"), F.max("idx").alias("last_idx")))


@query(f"with {RUNS_SQL}, r as (select case when run % 2 = 0 then 'base' else 'other' || (run % 3) end as recipe, 'k' || (run % 7) as key, cast(run % 4 as varchar) as value from runs), x as (select recipe, key, max(value) as value from r group by 1, 2), b as (select key, value from x where recipe = 'base'), n as (select distinct recipe from x where recipe <> 'base') select recipe, key from (select n.recipe, b.key, b.value as v1, x.value as v2 from n cross join b left join x on x.recipe = n.recipe and x.key = b.key union all select x.recipe, x.key, null, x.value from x where recipe <> 'base' and key not in (select key from b)) where key <> 'k0' and v1 is distinct from v2")
def recipe_differences(spark, d):
    r = runs(spark, d)
    recipe = F.when(F.col("run") % 2 == 0, "base").otherwise(F.concat(F.lit("other"), (F.col("run") % 3).cast("string")))
    x = r.groupBy(recipe.alias("recipe"), F.concat(F.lit("k"), (F.col("run") % 7).cast("string")).alias("key")).agg(F.max((F.col("run") % 4).cast("string")).alias("value"))
    return aggregate.recipe_differences(x, "base", ("k0",))


@query()
def suite_board(spark, d):
    from windloom.sources.views import slices

    c, p = cells(spark, d), slices(spark, d)
    frames = lambda f: f.withColumns({"segment": F.floor(F.col("s") / 16), "frame": (F.floor(F.col("s") / 2) % 8).cast("int")})
    halves = lambda f: (f.where("s % 2 = 0"), f.where("s % 2 = 1"))
    seeds = halves(c.withColumn("month", F.floor(F.col("s") / 2) % 4))
    tracks = halves(frames(p).withColumn("level", F.lit(0)))  # a segment is one track, whatever its planes' labels
    return rounded(boards.run_suite(*halves(c), planes=halves(p), seeds=(*seeds, ["month"]), series=halves(frames(c)), tracks=tracks, points=("y", "x")))


@query()
def rollout_summary(spark, d):
    import numpy as np

    field = np.linspace(-1.5, 1.5, 15 * 15).reshape(15, 15)
    steps = arena.rollouts(arena.episodes(spark, ["random", "clip"], 8), arena.Arena(field, mode="clip"))
    return rounded(arena.summarise(steps).drop("terminated", "reached"), 4)
