"""Queries on spectra, ensembles, time series, generators, planning and streams."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from windloom.functions import noise
from windloom.functions.shared import shared_folder
from windloom.operators import arena, boards, crops, ensemble, fields, launcher, lazyfield, planning, spectra, temporal, windows
from windloom.plans.base import query, rounded
from windloom.plans.spectral_sql import WINDOWED_SQL
from windloom.plans.window_queries import _JX, _JY, jumps_sql
from windloom.sources import artifact
from windloom.sources.views import CELLS_SQL, HOURLY_SQL, RUNS_SQL, cells, hourly, runs, slices, table

_DFT = f"""{CELLS_SQL}, c as (select s, y, x, u - avg(u) over (partition by s) as u, v - avg(v) over (partition by s) as v from cells),
 w as (select ky, kx from (select unnest(range(8)) as ky), (select unnest(range(8)) as kx)),
 f as (select s, ky, kx, sum(u * cos(2*pi()*(ky*y + kx*x)/8.0)) as uc, sum(u * sin(2*pi()*(ky*y + kx*x)/8.0)) as us, sum(v * cos(2*pi()*(ky*y + kx*x)/8.0)) as vc, sum(v * sin(2*pi()*(ky*y + kx*x)/8.0)) as vs from c, w group by 1, 2, 3),
 power as (select s, ky, kx, 0.5 * (uc*uc + us*us + vc*vc + vs*vs) as power from f)"""


@query(f"with {_DFT} select s, cast(ky as bigint) as ky, cast(kx as bigint) as kx, round(power, 6) as power from power")
def relational_dft(spark, d):
    return rounded(spectra.relational_power(cells(spark, d), ["s"], 8, 8))


_SHELL = "sh as (select s, floor(sqrt(pow((case when ky < 4 then ky else ky - 8 end) / 8.0, 2) + pow((case when kx < 4 then kx else kx - 8 end) / 8.0, 2)) * 8 - 0.5) as j, power from power)"


@query(f"with {_DFT}, {_SHELL} select s, cast(j as bigint) as j, round(avg(power), 6) as p from sh where j >= 0 and j < 4 group by 1, 2")
def shell_average(spark, d):
    c = cells(spark, d)
    return rounded(spectra.shells(spectra.relational_power(c, ["s"], 8, 8), ["s"], 8, 8))


@query(f"with {_DFT}, {_SHELL}, p as (select s, j, avg(power) as p from sh where j >= 0 and j < 4 group by 1, 2) select cast(j as bigint) as j, round(exp(avg(ln(p + 1e-30))), 6) as p from p group by j")
def mean_spectrum(spark, d):
    c = cells(spark, d)
    return rounded(spectra.mean_spectrum(spectra.shells(spectra.relational_power(c, ["s"], 8, 8), ["s"], 8, 8), ["j"]))


def _spectra(spark, d):
    p = slices(spark, d)
    return [spectra.mean_spectrum(spectra.plane_power(p.where(f"s % 2 = {k}"), ["s"], 8, 8)) for k in (0, 1)]


RESIDUAL_SQL = f"with {WINDOWED_SQL} select kind, round(sqrt(avg(pow(ln(a) - ln(b), 2))), 6) as residual from ab group by kind"


@query(RESIDUAL_SQL)
def spectral_residual(spark, d):
    return rounded(spectra.spectral_residual(*_spectra(spark, d)))


@query(f"""with {WINDOWED_SQL}, lo as (select j, (a / b < 0.5) as low from ab where kind = 'E'), r as (select j, count(*) over w as n, bool_and(low) over w as every from lo window w as (order by j rows between current row and 4 following)),
 first as (select min((j + 1) / 8.0) as k from r where every and n = 5) select round(1 / coalesce((select k from first), (select max((j + 1) / 8.0) from lo)), 6)::double as l_eff, (select k from first) is null as resolved""")
def effective_resolution(spark, d):
    return rounded(spectra.effective_resolution(*_spectra(spark, d)))


@query()
def plane_diagnostics(spark, d):
    return rounded(spectra.plane_diagnostics(slices(spark, d), ["s"], 8, 8))


@query()
def phase_shuffle(spark, d):
    return spectra.phase_shuffle(slices(spark, d), ["s"], 8, 8)


@query()
def white_noise(spark, d):
    return rounded(ensemble.white_noise(cells(spark, d)))


@query()
def patch_distance(spark, d):
    c = cells(spark, d)
    return rounded(ensemble.multiscale_patch_distance(c.where("s % 2 = 0"), c.where("s % 2 = 1"), 8))


_S2_SQL = " union all ".join(f"select {lag} as lag, side, avg(m) as s2 from (select s % 2 as side, axis, avg(du*du + dv*dv) as m from ({_JX.format(lag=lag)} union all {_JY.format(lag=lag)}) where du is not null group by 1, 2) group by side" for lag in (1, 2, 4))


@query(f"with {CELLS_SQL}, q as ({_S2_SQL}) select round(sqrt(avg(pow(ln(a.s2 + 1e-30) - ln(b.s2 + 1e-30), 2))), 6) as rmse from q a join q b on a.lag = b.lag and a.side = 0 and b.side = 1")
def structure_log_rmse(spark, d):
    c = cells(spark, d)
    return rounded(ensemble.structure_log_rmse(c.where("s % 2 = 0"), c.where("s % 2 = 1"), ["s"], (1, 2, 4)))


_SIDES = " union all ".join(f"select {lag} as lag, side, avg(p) as p from (select side, '{axis}' as axis, avg(u * lu + v * lv) as p from (select s % 2 as side, u, v, lead(u, {lag}) over w as lu, lead(v, {lag}) over w as lv from c window w as (partition by s, {other} order by {axis})) group by 1) group by side, lag" for lag in range(4) for axis, other in (("x", "y"), ("y", "x")))


@query(f"with {CELLS_SQL}, c as (select s, y, x, u - avg(u) over (partition by s) as u, v - avg(v) over (partition by s) as v from cells), k as (select lag, side, avg(p) as p from ({_SIDES}) group by 1, 2), r as (select lag, side, p / first_value(p) over (partition by side order by lag) as r from k) select round(sqrt(avg(pow(a.r - b.r, 2))), 6) as rmse from r a join r b on a.lag = b.lag and a.side = 0 and b.side = 1")
def correlation_rmse(spark, d):
    c = cells(spark, d)
    return rounded(ensemble.correlation_rmse(c.where("s % 2 = 0"), c.where("s % 2 = 1"), ["s"], range(4)))


@query(f"with {CELLS_SQL}, {jumps_sql()}, q as (select s % 2 as side, unnest(quantile_cont(jump, [i / 1023.0::double for i in range(1024)])) as x, unnest(range(1024)) as i from jumps group by 1) select round(avg(abs(a.x - b.x)), 6) as w1 from q a join q b on a.i = b.i and a.side = 0 and b.side = 1")
def gradient_w1(spark, d):
    c = cells(spark, d)
    return rounded(ensemble.gradient_w1(c.where("s % 2 = 0"), c.where("s % 2 = 1"), ["s"]))


@query(f"""with {CELLS_SQL}, m as (select s, s % 4 as g, s // 4 % 3 as m, y, x, u, v from cells), a as (select g, m, y, x, avg(u) as u, avg(v) as v from m group by 1, 2, 3, 4),
 p as (select a.g, a.m as m1, b.m as m2, sqrt(avg((a.u - b.u) ** 2 + (a.v - b.v) ** 2)) as rms from a join a b on a.g = b.g and a.y = b.y and a.x = b.x and a.m < b.m group by 1, 2, 3) select g, round(avg(rms), 6) as rms from p group by g""")
def pairwise_spread(spark, d):
    from windloom.operators.aggregate import pairwise_spread as spread

    m = cells(spark, d).groupBy((F.col("s") % 4).alias("g"), (F.floor(F.col("s") / 4) % 3).alias("m"), "y", "x").agg(F.avg("u").alias("u"), F.avg("v").alias("v"))
    return rounded(spread(m, ["g"], "m", ["y", "x"]))


@query()
def temporal_spectrum(spark, d):
    s = windows.segments(hourly(spark, d), ["series"])
    return rounded(temporal.temporal_psd(temporal.segment_psd(s, ["series"], [], 3600.0), ["series"]))


@query()
def tracer_dispersion(spark, d):
    p = slices(spark, d).withColumn("segment", F.floor(F.col("s") / 8)).withColumn("frame", (F.col("s") % 8).cast("int"))
    return rounded(temporal.dispersion(p, ["segment"], 8, 8, 3600.0, 28000.0, 28000.0))


@query(f"""with {CELLS_SQL}, p as (select s, f.frame, y, x, greatest(0, least(6.999, y + f.frame * 5.0 * 3600 / 28000)) as yp, greatest(0, least(6.999, x - f.frame * 10.0 * 3600 / 28000)) as xp from cells, (select unnest(range(4)) as frame) f), q as (select *, cast(floor(yp) as integer) as j, cast(floor(xp) as integer) as i from p)
 select q.s, q.frame::bigint as frame, q.y::bigint as y, q.x::bigint as x, round(sum(c.u * (case when c.y = j then 1 - (yp - j) else yp - j end) * (case when c.x = i then 1 - (xp - i) else xp - i end)), 6) as u, round(sum(c.v * (case when c.y = j then 1 - (yp - j) else yp - j end) * (case when c.x = i then 1 - (xp - i) else xp - i end)), 6) as v
 from q join cells c on c.s = q.s and c.y between j and j + 1 and c.x between i and i + 1 group by 1, 2, 3, 4""")
def advected_field(spark, d):
    return rounded(temporal.advected(slices(spark, d), ["s"], 4, 8, 8, (10.0, -5.0), 28000.0, 3600.0))


@query(f"with {HOURLY_SQL} select series, count(*) as n, round(avg(u), 6) as mean from hourly group by series")
def hourly_means(spark, d):
    return rounded(hourly(spark, d).groupBy("series").agg(F.count("*").alias("n"), F.avg("u").alias("mean")))


@query()
def crop_channels(spark, d):
    c = cells(spark, d).withColumn("t", F.col("s").cast("int"))
    n = table(spark, d, "embeddings").count() // 2
    return rounded(crops.channels(crops.crops(c, crops.crop_index(spark, 64, n, 8, 8, 4), 4)))


@query(f"with {CELLS_SQL} select s, cast(level as bigint) as level, round(sum(u), 5) as su, round(sum(v), 5) as sv, count(*) as n from cells group by 1, 2")
def planes_round_trip(spark, d):
    """Cells to planes and back."""
    p = artifact.to_planes(cells(spark, d).withColumnRenamed("s", "t"), ["t", "level"])
    c = artifact.make_cells(p, 8, 8)
    return rounded(c.groupBy(F.col("t").alias("s"), "level").agg(F.sum("u").alias("su"), F.sum("v").alias("sv"), F.count("*").alias("n")), 5)


@query("with p as (select * from (values (4, 2, 64, 32, 9), (16, 4, 32, 16, 25), (64, 8, 16, 8, 81)) t(core_tiles, tiles_per_axis, win, stride, expected_final_windows)) select core_tiles::bigint as core_tiles, tiles_per_axis::bigint as tiles_per_axis, win::bigint as window, stride::bigint as stride, expected_final_windows::bigint as expected_final_windows from p")
def tiling_profiles(spark, d):
    return rounded(boards.profiles(spark))


@query("select cast(i as bigint) as step, round(case when i >= 18 then 0.0 else (80.0 ** (1/7.0) + i / 17.0 * (0.002 ** (1/7.0) - 80.0 ** (1/7.0))) ** 7 end, 6)::double as sigma from (select unnest(range(19)) as i)")
def sigma_schedule(spark, d):
    return rounded(spark.range(19).select(F.col("id").alias("step"), noise.sigma_schedule(F.col("id"), 18, 0.002, 80.0).alias("sigma")))


@query("select cast(i as bigint) as i, round(1 - 0.99 * abs(i - 7.5) / 7.5, 6)::double as w from (select unnest(range(16)) as i)")
def blend_weights(spark, d):
    return rounded(spark.range(16).select(F.col("id").alias("i"), noise.ramp(F.col("id"), 16).alias("w")))


@query()
def coordinate_noise(spark, d):
    return rounded(lazyfield.coordinate_noise(lazyfield.box(spark, -8, 8, -8, 8, 0, 2), 2, 7))


_M64 = "18446744073709551616::uhugeint"


@query(f"""with b as (select y, x from (select unnest(range(8)) as y), (select unnest(range(8)) as x)),
 h as (select y, x, xor(xor((7::uhugeint * {0x9E3779B97F4A7C15}) % {_M64}, (y::uhugeint * {0xBF58476D1CE4E5B9}) % {_M64}), (x::uhugeint * {0x94D049BB133111EB}) % {_M64}) as h from b)
 select y::integer as y, x::integer as x, (xor(h, h // 2147483648::uhugeint) % 9223372036854775808::uhugeint)::bigint as seed from h""")
def tile_seeds(spark, d):
    return lazyfield.box(spark, 0, 8, 0, 8).select("y", "x", noise.tile_seed(F.lit(7), F.col("y"), F.col("x")).alias("seed"))


@query()
def infinite_field(spark, d):
    return rounded(lazyfield.InfiniteField(window=8, depth=2, seed=7).materialise(spark, 0, 16, 0, 16))


@query("select r::integer as round, cast(pow((64 + 64 * (1 - r) - 1) // 32 - ((-64 * (1 - r) - 64) // 32 + 1) + 1, 2) as bigint) as windows from (select unnest([0, 1]) as r)")
def window_calls(spark, d):
    return lazyfield.InfiniteField(window=64, stride=32, depth=2).calls(spark, 0, 64, 0, 64)


@query()
def chart_field(spark, d):
    return rounded(lazyfield.ChartField(core=8, halo=4, window=8, stride=4, seed=7).materialise(spark, 0, 16, 0, 16))


@query()
def consensus_chart_field(spark, d):
    return rounded(lazyfield.ChartField(core=8, halo=4, window=8, stride=4, seed=7, strategy="consensus").materialise(spark, 0, 16, 0, 16))


@query(f"with {CELLS_SQL}, n as (select count(*) // 2 as n from embeddings), b as (select t, y, x from (select unnest(range(-1, (select n + 2 from n))) as t), (select unnest(range(-4, 12)) as y), (select unnest(range(-4, 12)) as x)) select b.t::bigint as t, b.y::bigint as y, b.x::bigint as x, round(c.u, 6) as u, round(c.v, 6) as v from b join cells c on c.s = ((b.t % (select n from n)) + (select n from n)) % (select n from n) and c.y = (b.y + 8) % 8 and c.x = (b.x + 8) % 8")
def periodic_replay(spark, d):
    base = cells(spark, d).select(F.col("s").cast("int").alias("t"), "y", "x", "u", "v")
    n = table(spark, d, "embeddings").count() // 2
    return rounded(artifact.periodic(base, lazyfield.box(spark, -4, 12, -4, 12, -1, n + 2), (n, 8, 8)))


@query()
def random_feature_field(spark, d):
    g = arena.grid(spark, 20, 20)
    u, v = fields.RandomFeatureField(planar=True, lengthscale=4.0, seed=3).velocity(F.col("i"), F.col("j"))
    return rounded(g.select("i", "j", u.alias("u"), v.alias("v")))


@query("select cast(i as bigint) as i, cast(j as bigint) as j, (1.5 + 0.5 * 2.0)::double as u from (select unnest(range(1, 6)) as i), (select unnest(range(1, 6)) as j)")
def field_algebra(spark, d):
    f = fields.ConstantField(1.5) + fields.ConstantField(2.0) * 0.5 + fields.ZeroField()
    u, _ = f.velocity(F.col("i"), F.col("j"))
    return rounded(arena.grid(spark, 5, 5).select("i", "j", u.alias("u")))


@query()
def fitted_field(spark, d):
    base = fields.RandomFeatureField(lengthscale=4.0, seed=3)
    g = arena.grid(spark, 20, 20)
    truth, _ = base.velocity(F.col("i"), F.col("j"))
    obs = g.where((F.col("i") + F.col("j")) % 2 == 0).select("i", "j", truth.alias("u"))
    u, _ = fields.FittedField(fields.RandomFeatureField(lengthscale=4.0, seed=4), 0.05).fit(obs).velocity(F.col("i"), F.col("j"))
    return rounded(g.select("i", "j", u.alias("u"), truth.alias("truth")), 4)


@query()
def actor_mass(spark, d):
    m = arena.clipped_gaussian(1.0, 0.4, 2)
    return rounded(spark.createDataFrame([(a, z - 2, float(m[a, z])) for a in range(3) for z in range(5)], "action int, z int, p double"))


@query("with recursive g as (select i, j, case when sqrt((i - 4) ** 2 + (j - 4) ** 2) <= 1 then 0.0 else -1.0 end as r from (select unnest(range(1, 8)) as i), (select unnest(range(1, 8)) as j)) select cast(i as bigint) as i, cast(j as bigint) as j, r::double as reward from g")
def reward_table(spark, d):
    return rounded(arena.grid(spark, 7, 7).select("i", "j", arena.step_cost(F.col("i"), F.col("j"), (4.0, 4.0), 1.0).alias("reward")))


def _drift(n_x, n_y):
    out = np.zeros((n_x, n_y, 3))
    out[:, :, 1] = 0.6
    out[: n_x // 2, :, 2], out[n_x // 2 :, :, 2] = 0.3, 0.1
    out[: n_x // 2, :, 0], out[n_x // 2 :, :, 0] = 0.1, 0.3
    return out


_STEPS = ",\n ".join(f"a{k + 1} as (select i, j, value + r as ahead from v{k} join g using (i, j)), q{k + 1} as (select g.i, g.j, a.a as action, sum(p.p * coalesce(n.ahead, 0)) as q from g cross join (select unnest([0, 1, 2]) as a) a join dr p on p.i = g.i left join a{k + 1} n on n.i = g.i + p.d and n.j = g.j + a.a - 1 group by 1, 2, 3), v{k + 1} as (select i, j, max(q) as value, arg_min(action, (-q, action)) as action from q{k + 1} group by 1, 2)" for k in range(4))


@query(f"""with g as (select i, j, case when sqrt((i - 4) ** 2 + (j - 4) ** 2) <= 1 then 0.0 else -1.0 end::double as r from (select unnest(range(1, 8)) as i), (select unnest(range(1, 8)) as j)),
 dr as (select i, d, (case when d = 0 then 0.6 when (d = 1) = (i <= 3) then 0.3 else 0.1 end)::double as p from (select unnest(range(1, 8)) as i), (select unnest([-1, 0, 1]) as d)),
 v0 as (select i, j, 0.0::double as value from g),
 {_STEPS}
 select i::bigint as i, j::bigint as j, round(value, 6) as value, action::bigint as action from v4""")
def backward_induction(spark, d):
    n = 7
    drift = _drift(n, n)
    rows = [(i + 1, j + 1, k - 1, float(drift[i, j, k])) for i in range(n) for j in range(n) for k in range(3)]
    moves = planning.transitions(spark, spark.createDataFrame(rows, "i int, j int, d int, p double"), arena.clipped_gaussian(1.0, 0.0, 1), n, n)
    return rounded(planning.backward_induction(reward_table(spark, d).selectExpr("cast(i as int) i", "cast(j as int) j", "reward"), moves, 4))


@query()
def all_pairs_costs(spark, d):
    goals = arena.grid(spark, 7, 7).withColumnsRenamed({"i": "gi", "j": "gj"})
    return rounded(planning.shortest_costs(goals, _drift(7, 7), arena.clipped_gaussian(1.0, 0.3, 2), 1.0), 4)


@query()
def gp_estimate(spark, d):
    o = table(spark, d, "supplier").select((F.col("s_suppkey") * 7 % 12 + 1).cast("int").alias("i"), (F.col("s_suppkey") * 5 % 12 + 1).cast("int").alias("j"), (F.col("s_acctbal") / 5000).alias("y"))
    return rounded(planning.expected_improvement(planning.estimate(o, 12, 12), 0.5), 4)


@query()
def most_uncertain_cells(spark, d):
    o = table(spark, d, "supplier").select((F.col("s_suppkey") * 7 % 12 + 1).cast("int").alias("i"), (F.col("s_suppkey") * 5 % 6 + 1).cast("int").alias("j"), (F.col("s_acctbal") / 5000).alias("y"))
    return rounded(planning.most_uncertain(planning.estimate(o, 12, 12), 5), 4)


@query()
def suite_launch(spark, d):
    suite = {"defaults": {"n": 3, "opt": {"x": 1}}, "runs": [{"name": "a"}, {"name": "b", "n": 5}, {"name": "c", "opt": {"x": 0}}]}
    return launcher.launch(spark, suite, lambda c: {"mean": c["n"] / c["opt"]["x"]})


@query("select cast(l_linenumber as bigint) as level, round(avg(l_extendedprice), 4) as mean_u, round(stddev_pop(l_extendedprice) + 1e-6, 4) as std_u, round(avg(l_quantity), 4) as mean_v, round(stddev_pop(l_quantity) + 1e-6, 4) as std_v from lineitem group by 1")
def streamed_stats(spark, d):
    """The normalisation statistics by a stream over files, stopped after one batch and taken up again."""
    from windloom.streaming.incremental import streamed_stats as stats

    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    table(spark, d, "lineitem").select(F.col("l_linenumber").alias("level"), F.col("l_extendedprice").alias("u"), F.col("l_quantity").alias("v")).repartition(3).write.parquet(f"{base}/in")
    how = (f"{base}/in", "level int, u double, v double", f"{base}/ck", "streamed_stats_view")
    stats(spark, *how, max_batches=1)
    return rounded(stats(spark, *how), 4)


@query(f"with {RUNS_SQL} select cast(month as bigint) as month, cast(hour as bigint) as hour, count(*) as n, round(avg(seconds), 4) as mean_s, round(quantile_cont(seconds, 0.1), 4) as p10_s, round(quantile_cont(seconds, 0.5), 4) as median_s, round(quantile_cont(seconds, 0.9), 4) as p90_s, round(coalesce(quantile_cont(case when not isnan(memory) then memory end, 0.5), 'nan'::double), 4) as memory from runs group by 1, 2")
def condition_board(spark, d):
    """Board of two methods' costs by condition, long form."""
    from windloom.operators.aggregate import performance

    r = runs(spark, d)
    return rounded(performance(r, ["month", "hour"]), 4)
