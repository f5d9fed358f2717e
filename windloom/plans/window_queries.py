"""Queries on neighbours, seams, segments, alignment, interpolation and vertical physics."""

from __future__ import annotations

from pyspark.sql import functions as F

from windloom.functions import columns
from windloom.functions.levels import half_levels_sql
from windloom.operators import align, arena, physics, windows
from windloom.plans.base import query, rounded
from windloom.sources.views import CELLS_SQL, HOURLY_SQL, RUNS_SQL, cells, hourly, runs, samples, slices, table

_JX = "select s, 'x' as axis, x as loc, y as line, u, v, lead(u, {lag}) over w as u1, lead(v, {lag}) over w as v1, lead(u, {lag}) over w - u as du, lead(v, {lag}) over w - v as dv from cells window w as (partition by s, y order by x)"
_JY = "select s, 'y' as axis, y as loc, x as line, u, v, lead(u, {lag}) over w as u1, lead(v, {lag}) over w as v1, lead(u, {lag}) over w - u as du, lead(v, {lag}) over w - v as dv from cells window w as (partition by s, x order by y)"


def jumps_sql(lag: int = 1) -> str:
    return f"jumps as (select *, sqrt(du*du + dv*dv) as jump from ({_JX.format(lag=lag)} union all {_JY.format(lag=lag)}) where du is not null)"


@query(f"with {CELLS_SQL}, {jumps_sql()}, j as (select *, (loc + 1) % 4 = 0 as seam, (u*u1 + v*v1) / greatest(sqrt(u*u + v*v) * sqrt(u1*u1 + v1*v1), 1e-6) as cosine from jumps) select round(avg(jump) filter (seam) / greatest(avg(jump), 1e-12), 6) as jump_ratio, round(avg(jump*jump) filter (seam) / greatest(avg(jump*jump), 1e-12), 6) as squared_ratio, round(avg(cosine) filter (seam), 6) as seam_cosine, round(avg(cosine), 6) as all_cosine, round(avg(cosine) - avg(cosine) filter (seam), 6) as direction_gap from j")
def boundary_coherence(spark, d):
    return rounded(windows.boundary_coherence(cells(spark, d), ["s"], 4))


@query(f"with {CELLS_SQL}, {jumps_sql()} select axis, round(avg(jump) filter ((loc + 1) % 4 = 0), 6) as seam, round(avg(jump) filter ((loc + 1) % 4 <> 0), 6) as rest, round(avg(jump), 6) as mean, round(avg(jump) filter ((loc + 1) % 4 = 0) / avg(jump), 6) as ratio from jumps group by axis")
def seam_ratios(spark, d):
    return rounded(windows.seam_ratios(cells(spark, d), ["s"], 4))


_S2 = " union all ".join(f"select {lag} as lag, (select avg(m) from (select axis, avg(du*du + dv*dv) as m from ({_JX.format(lag=lag)} union all {_JY.format(lag=lag)}) where du is not null group by axis)) as s2" for lag in (1, 2, 4))


@query(f"with {CELLS_SQL} select cast(lag as bigint) as lag, round(s2, 6) as s2 from ({_S2})")
def structure_function(spark, d):
    return rounded(windows.structure_function(cells(spark, d), ["s"], (1, 2, 4)))


@query(f"with {CELLS_SQL}, {jumps_sql(2)} select round(kurtosis_pop(du) + 3, 6) as kurtosis from jumps")
def increment_kurtosis(spark, d):
    return rounded(windows.increment_kurtosis(cells(spark, d), ["s"]))


_G = """g as (select *, coalesce((lead(v) over wx - lag(v) over wx) / 2, lead(v) over wx - v, v - lag(v) over wx) as vx, coalesce((lead(u) over wx - lag(u) over wx) / 2, lead(u) over wx - u, u - lag(u) over wx) as ux,
 coalesce((lead(u) over wy - lag(u) over wy) / 2, lead(u) over wy - u, u - lag(u) over wy) as uy, coalesce((lead(v) over wy - lag(v) over wy) / 2, lead(v) over wy - v, v - lag(v) over wy) as vy
 from cells window wx as (partition by s, y order by x), wy as (partition by s, x order by y))"""


@query(f"with {CELLS_SQL}, {_G} select s, cast(y as bigint) as y, cast(x as bigint) as x, round(vx - uy, 6) as vort, round(ux + vy, 6) as div from g")
def vorticity_divergence(spark, d):
    return rounded(windows.vorticity_divergence(cells(spark, d), ["s"]).select("s", "y", "x", "vort", "div"))


@query(f"with {CELLS_SQL}, {_G} select round(stddev_pop(vx - uy) / (stddev_pop(ux + vy) + 1e-12), 6) as ratio from g")
def vorticity_divergence_ratio(spark, d):
    return rounded(windows.vorticity_divergence_ratio(cells(spark, d), ["s"]))


_CURVE = " union all ".join(f"select {lag} as lag, avg(p) as p from (select avg(u * lu + v * lv) as p from (select u, v, lead(u, {lag}) over w as lu, lead(v, {lag}) over w as lv from c window w as (partition by s, y order by x)) union all select avg(u * lu + v * lv) from (select u, v, lead(u, {lag}) over w as lu, lead(v, {lag}) over w as lv from c window w as (partition by s, x order by y)))" for lag in range(5))
_CURVE_SQL = f"{CELLS_SQL}, c as (select s, y, x, u - avg(u) over (partition by s) as u, v - avg(v) over (partition by s) as v from cells), k as ({_CURVE}), curve as (select lag, p / (select p from k where lag = 0) as correlation from k)"


@query(f"with {_CURVE_SQL} select cast(lag as bigint) as lag, round(correlation, 6) as correlation from curve")
def correlation_curve(spark, d):
    return rounded(windows.correlation_curve(cells(spark, d), ["s"], range(5)))


@query(f"with {_CURVE_SQL}, q as (select *, lag(lag) over (order by lag) as l0, lag(correlation) over (order by lag) as c0 from curve), f as (select * from q where correlation <= 0.5 order by lag limit 1) select round(coalesce((select l0 + (c0 - 0.5) / (c0 - correlation) * (lag - l0) from f), (select max(lag) from curve)) * 27.83, 6) as coherence_km")
def coherence_length(spark, d):
    return rounded(windows.coherence_length(windows.correlation_curve(cells(spark, d), ["s"], range(5))))


_SEG = "st as (select *, epoch_us(time) / 1e6 - lag(epoch_us(time) / 1e6) over (partition by series order by time) as step from hourly), md as (select series, quantile_cont(step, 0.5) as typical from st group by series), sg as (select st.*, sum(case when step > 1.5 * typical then 1 else 0 end) over (partition by st.series order by time) as segment from st join md on st.series = md.series), fr as (select *, row_number() over (partition by series, segment order by time) - 1 as frame, count(*) over (partition by series, segment) as frames from sg)"


@query(f"with {HOURLY_SQL}, {_SEG} select series, cast(segment as bigint) as segment, count(*) as frames, cast(min(time) as varchar) as start from fr where frames >= 16 group by 1, 2")
def contiguous_segments(spark, d):
    s = windows.segments(hourly(spark, d), ["series"], least=16)
    return rounded(s.groupBy("series", "segment").agg(F.count("*").alias("frames"), F.date_format(F.min("time"), "yyyy-MM-dd HH:mm:ss").alias("start")))


@query(f"with {HOURLY_SQL}, {_SEG} select series, round(quantile_cont(step, 0.5) / 3600, 6) as hours from st group by series")
def median_step(spark, d):
    return rounded(windows.median_step_hours(hourly(spark, d), ["series"]))


@query(f"with {HOURLY_SQL}, {_SEG}, dd as (select series, segment, sqrt((u - lag(u) over w) ** 2 + (v - lag(v) over w) ** 2) as d from fr window w as (partition by series, segment order by frame)) select series, round(avg(m), 6) as change from (select series, segment, avg(d) as m from dd group by 1, 2) group by series")
def adjacent_change(spark, d):
    return rounded(windows.adjacent_change(windows.segments(hourly(spark, d), ["series"]), ["series"]))


@query(f"with {HOURLY_SQL}, {_SEG}, dd as (select series, segment, frame, sqrt((lead(u) over w - u) ** 2 + (lead(v) over w - v) ** 2) as d from fr window w as (partition by series, segment order by frame)) select series, round(avg(s) / avg(m), 6) as ratio from (select series, segment, avg(d) as m, avg(d) filter ((frame + 1) % 4 = 0) as s from dd group by 1, 2) group by series")
def seam_jump_ratio(spark, d):
    return rounded(windows.seam_jump_ratio(windows.segments(hourly(spark, d), ["series"]), ["series"], 4))


@query(f"with {CELLS_SQL}, p as (select level, s, u as a, lead(u) over w as b from cells window w as (partition by level, y, x order by s) union all select level, s, v, lead(v) over w from cells window w as (partition by level, y, x order by s)) select cast(level as bigint) as level, s, round(corr(a, b), 6) as r from p where b is not null group by 1, 2")
def frame_correlations(spark, d):
    return rounded(windows.frame_correlations(cells(spark, d), "s"))


@query(f"with {HOURLY_SQL}, {_SEG}, b as (select series, segment, frame, count(*) over (partition by series, segment order by frame rows between current row and 3 following) as n from fr) select series, count(*) as blocks from b where n = 4 group by series")
def valid_blocks(spark, d):
    b = windows.valid_blocks(windows.segments(hourly(spark, d), ["series"]), 4, ["series"])
    return rounded(b.groupBy("series").agg(F.count("*").alias("blocks")))


@query(f"with {HOURLY_SQL}, {_SEG} select a.series, count(*) as pairs, round(avg(b.u - a.u), 6) as mean_change from fr a join fr b on a.series = b.series and a.segment = b.segment and b.frame = a.frame + 2 group by a.series")
def frame_pairs(spark, d):
    p = windows.frame_pairs(windows.segments(hourly(spark, d), ["series"]), 2, ["series"])
    return rounded(p.groupBy("series").agg(F.count("*").alias("pairs"), F.avg(F.col("next_u") - F.col("u")).alias("mean_change")))


@query("""with recursive st as (select l_orderkey as o, l_linenumber as step, min(l_discount) as reward, min(l_tax) as value, min(l_returnflag) = 'R' as done from lineitem group by 1, 2),
 od as (select *, row_number() over (partition by o order by step desc) as k from st),
 g(o, k, value, done, adv) as (
  select o, k, value, done, reward + 0.99 * ((o % 7) / 10.0) * (case when o % 2 = 0 then 0.0 else 1.0 end) - value from od where k = 1
  union all
  select od.o, od.k, od.value, od.done, od.reward + 0.99 * g.value * (case when g.done then 0.0 else 1.0 end) - od.value + 0.99 * 0.95 * (case when g.done then 0.0 else 1.0 end) * g.adv from g join od on od.o = g.o and od.k = g.k + 1)
 select o, round(sum(adv) + 0.0000001234, 6) as total, round(sum(adv + value) + 0.0000001234, 6) as returns, count(*) as n from g group by o""")
def advantages(spark, d):
    r = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("step")).agg(F.min("l_discount").alias("reward"), F.min("l_tax").alias("value"), (F.min("l_returnflag") == "R").alias("done"))
    r = r.withColumns({"after": F.col("o") % 7 / 10.0, "over": F.col("o") % 2 == 0})
    g = windows.advantages(r, ["o"], last_value="after", last_done="over")
    total = lambda c: F.aggregate(c, F.lit(0.0000001234), lambda a, x: a + x)  # noqa: E731  off the ties of rounding
    return rounded(g.select("o", total("gae").alias("total"), total("returns").alias("returns"), F.size("gae").alias("n")))


@query("with r as (select l_orderkey as o, l_linenumber as step, max(l_discount) as value from lineitem group by 1, 2) select o, cast(step as bigint) as step, round(sum(0.1 - value) over w, 6) as regret, round(max(value) over w, 6) as running_max from r window w as (partition by o order by step rows unbounded preceding)")
def running_regret(spark, d):
    r = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("step")).agg(F.max("l_discount").alias("value"))
    return rounded(windows.regret(r, ["o"], 0.1).drop("value"))


@query("with r as (select l_orderkey as o, l_linenumber as a, max(l_quantity) as q from lineitem group by 1, 2) select o, cast(a as bigint) as a, round(q, 4) as q from (select *, row_number() over (partition by o order by q desc, a) as k from r) where k = 1")
def first_argmax(spark, d):
    r = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("a")).agg(F.max("l_quantity").alias("q"))
    return rounded(windows.first_argmax(r, ["o"], "q", "a"), 4)


# Alignment and interpolation

@query("with a as (select p_partkey as idx, cast(p_retailprice as double) as c from part), b as (select s_suppkey as idx, round(900 + s_suppkey / 10.0, 2)::double as c from supplier) select b.idx as target_idx, (select arg_min(a.idx, (abs(a.c - b.c), a.idx)) from a where abs(a.c - b.c) <= 0.05) as source_idx from b")
def nearest_within(spark, d):
    a = table(spark, d, "part").select(F.col("p_partkey").alias("idx"), F.col("p_retailprice").alias("c"))
    b = table(spark, d, "supplier").select(F.col("s_suppkey").alias("idx"), F.round(900 + F.col("s_suppkey") / 10.0, 2).alias("c"))
    return rounded(align.nearest(a, b, 0.05))


@query("select distinct round_even(p_size / 2.0, 6) as c from part where p_partkey % 2 = 0 intersect select distinct round_even(p_size / 4.0, 6) from part where p_partkey % 3 = 0")
def common_axis(spark, d):
    p = table(spark, d, "part")
    return rounded(align.common_axis([p.where("p_partkey % 2 = 0").select((F.col("p_size") / 2.0).alias("c")), p.where("p_partkey % 3 = 0").select((F.col("p_size") / 4.0).alias("c"))]))


@query("with h as (select distinct date_trunc('hour', ts) as h from events where event_id % 50 = 0) select count(*) as n, round(sum(value), 4) as total from events where date_trunc('hour', ts) in (select h from h)")
def rows_at_times(spark, d):
    e = table(spark, d, "events")
    return rounded(align.at_times(e, e.where("event_id % 50 = 0"), "ts").agg(F.count("*").alias("n"), F.sum("value").alias("total")), 4)


@query("with q as (select o_orderkey as id, cast(floor(o_totalprice) as bigint) % 500 as a from orders), c as (select id, a, unnest(generate_series(cast(floor((a - 4) / 16.0) as bigint), cast(ceil((a + 10 + 4) / 16.0) as bigint) - 1)) as chart from q) select chart, count(*) as n from c where chart * 16 - 4 < a + 10 and (chart + 1) * 16 + 4 > a group by chart")
def covering_charts(spark, d):
    q = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.floor("o_totalprice") % 500).alias("start")).withColumn("stop", F.col("start") + 10)
    return rounded(align.covering_charts(q, 16, 4).groupBy("chart").agg(F.count("*").alias("n")))


@query("with p as (select event_id as id, cast(floor(value * 10) as bigint) as t from events), c as (select distinct cast(s_suppkey * 7 as bigint) as t0, cast(s_suppkey * 7 + 20 as bigint) as t1 from supplier) select p.id, p.t, max(c.t0) as t0 from p join c on p.t >= c.t0 and p.t < c.t1 - 1 group by 1, 2")
def newest_chunk(spark, d):
    p = table(spark, d, "events").select(F.col("event_id").alias("id"), F.floor(F.col("value") * 10).alias("t"))
    c = table(spark, d, "supplier").select((F.col("s_suppkey") * 7).alias("t0"), (F.col("s_suppkey") * 7 + 20).alias("t1")).distinct()
    return rounded(align.newest_containing(p, c, 32))


_TAB = "t as (select cast(p_size as double) as x, avg(p_retailprice) as y from part where p_size % 3 = 0 group by 1), br as (select x as x0, y as y0, lead(x) over (order by x) as x1, lead(y) over (order by x) as y1 from t), q as (select distinct p_size + 0.5 as x from part)"


@query(f"with {_TAB} select cast(q.x as double) as x, round(coalesce((select y0 + (y1 - y0) * (q.x - x0) / (x1 - x0) from br where q.x >= x0 and q.x < x1), case when q.x < (select min(x) from t) then (select arg_min(y, x) from t) else (select arg_max(y, x) from t) end), 4) as y from q")
def interpolate_axis(spark, d):
    p = table(spark, d, "part")
    t = p.where("p_size % 3 = 0").groupBy(F.col("p_size").cast("double").alias("x")).agg(F.avg("p_retailprice").alias("y"))
    return rounded(align.lerp_on(p.select((F.col("p_size") + 0.5).cast("double").alias("x")).distinct(), t), 4)


_COL = "k as (select l_orderkey % 50 as c, l_linenumber as n, avg(l_extendedprice) as u, avg(l_quantity) as v from lineitem group by 1, 2), p as (select c, cast(n * 100 as double) as p, u, v from k)"


@query(f"with {_COL}, br as (select *, lead(p) over w as p1, lead(u) over w as u1, lead(v) over w as v1 from p window w as (partition by c order by p)) select c, t.t as pressure, round(u + (t.t - p) / (p1 - p) * (u1 - u), 4) as u, round(v + (t.t - p) / (p1 - p) * (v1 - v), 4) as v from br, (select unnest([150.0, 250.0, 475.0])::double as t) t where t.t >= p and t.t < p1")
def vertical_interpolation(spark, d):
    k = table(spark, d, "lineitem").groupBy((F.col("l_orderkey") % 50).alias("c"), "l_linenumber").agg(F.avg("l_extendedprice").alias("u"), F.avg("l_quantity").alias("v"))
    return rounded(align.vertical(k.withColumn("p", (F.col("l_linenumber") * 100).cast("double")), [150.0, 250.0, 475.0], ["c"]), 4)


@query(f"""with {CELLS_SQL}, p as (select s, 0.3 + (s % 7) as yp, 0.7 + (s % 6) as xp from (select distinct s from cells)), q as (select s, yp, xp, cast(floor(least(yp, 6.999)) as integer) as j, cast(floor(least(xp, 6.999)) as integer) as i from p), f as (select *, least(yp, 6.999) - j as fy, least(xp, 6.999) - i as fx from q)
 select f.s, round(sum(c.u * (case when c.y = j then 1 - fy else fy end) * (case when c.x = i then 1 - fx else fx end)), 6) as u, round(sum(c.v * (case when c.y = j then 1 - fy else fy end) * (case when c.x = i then 1 - fx else fx end)), 6) as v from f join cells c on c.s = f.s and c.y between j and j + 1 and c.x between i and i + 1 group by f.s""")
def bilinear_sample(spark, d):
    p = slices(spark, d)
    points = p.select("s", (0.3 + F.col("s") % 7).alias("yp"), (0.7 + F.col("s") % 6).alias("xp"))
    return rounded(align.bilinear(points, p, ["s"], 8, 8).select("s", "u", "v"))


def _blur():
    import math

    w = [math.exp(-0.5 * i * i) for i in range(-3, 4)]
    return "k(o, w) as (values " + ", ".join(f"({o}, {x / sum(w)!r}::double)" for o, x in zip(range(-3, 4), w)) + ")"


@query(f"with {CELLS_SQL}, {_blur()}, a as (select s, y + o as y, x, sum(u * w) as u, sum(v * w) as v from cells, k where y + o between 0 and 7 group by 1, 2, 3), b as (select s, y, x + o as x, sum(u * w) as u, sum(v * w) as v from a, k where x + o between 0 and 7 group by 1, 2, 3) select cast(y as bigint) as y, cast(x as bigint) as x, round(avg(u), 6) as u, round(avg(v), 6) as v from b group by 1, 2")
def gaussian_smooth(spark, d):
    b = align.smooth(cells(spark, d), ["s"], 1.0)
    return rounded(b.groupBy("y", "x").agg(F.avg("u").alias("u"), F.avg("v").alias("v")))


@query()
def regrid(spark, d):
    return rounded(align.regrid(cells(spark, d), ["s"], (8, 8), (5, 5)))


# Vertical physics and columns

@query(f"with half as (select * from {half_levels_sql()}), l as (select unnest(range(48, 68)) as level) select cast(l.level as bigint) as level, round(0.5 * (a.a + a.b * 101325 + b.a + b.b * 101325) / 100, 6) as hpa from l join half a on a.n = l.level - 1 join half b on b.n = l.level")
def standard_pressure(spark, d):
    return rounded(physics.standard_pressure_hpa(spark.range(48, 68).select(F.col("id").cast("int").alias("level"))))


def _columns(spark, d):
    o = table(spark, d, "lineitem").groupBy((F.col("l_orderkey") % 40).alias("c"), "l_linenumber").agg(F.avg("l_quantity").alias("u"), F.avg("l_extendedprice").alias("e"), F.avg("l_discount").alias("q"), F.avg("l_tax").alias("x"))
    o = o.select("c", (F.col("l_linenumber") + 50).alias("level"), "u", (F.col("e") / 1000).alias("v"), (210 + 100 * F.col("x")).alias("T"), (F.col("q") / 100).alias("q"), F.lit(101325.0).alias("sp"))
    return physics.altitude(physics.full_pressure(o), ["c"])


_ALT = f"""half as (select * from {half_levels_sql()}), o as (select l_orderkey % 40 as c, l_linenumber + 50 as level, avg(l_quantity) as u, avg(l_extendedprice) / 1000 as v, 210 + 100 * avg(l_tax) as t, avg(l_discount) / 100 as q from lineitem group by 1, l_linenumber),
 p as (select o.*, 0.5 * (a.a + a.b * 101325 + b.a + b.b * 101325) as p, t * (1 + 0.61 * q) as tv from o join half a on a.n = level - 1 join half b on b.n = level),
 z as (select *, coalesce(287.05 / 9.80665 * 0.5 * (tv + lead(tv) over w) * ln(lead(p) over w / p), 0) as dz from p window w as (partition by c order by level)),
 h as (select *, sum(dz) over (partition by c order by level desc rows unbounded preceding) as z from z)"""


@query(f"with {_ALT} select c, cast(level as bigint) as level, round(z, 4) as z, round(p, 4) as p from h")
def altitude(spark, d):
    return rounded(_columns(spark, d).select("c", "level", "z", "p"), 4)


@query(f"with {_ALT}, s as (select c, level, lead(u) over w - u as du, lead(v) over w - v as dv, abs(lead(z) over w - z) as d, 0.5 * (lead(z) over w + z) as m from h window w as (partition by c order by level)) select c, cast(level as bigint) as level, round(sqrt(du*du + dv*dv) / d, 6) as shear, round(m, 6) as z_mid from s where d is not null")
def vector_shear(spark, d):
    return rounded(physics.vector_shear(_columns(spark, d), ["c"]))


@query(f"with {_ALT}, t as (select level, abs(lead(z) over (partition by c order by level) - z) as d from h), k as (select level, avg(d) as d from t where d is not null group by level), s as (select level, u - lead(u) over (partition by c order by level) as x from h) select cast(s.level as bigint) as level, round(avg(x / d * 1000), 4) as mean_shear, count(*) as n from s join k using (level) where x is not null group by s.level")
def shear_samples(spark, d):
    c = _columns(spark, d)
    return rounded(physics.shear_samples(c, physics.layer_thickness(c, ["c"]), ["c"]).groupBy("level").agg(F.avg("shear").alias("mean_shear"), F.count("*").alias("n")), 4)


@query("with e as (select event_id, (epoch_us(ts) - epoch_us(date_trunc('year', ts))) / 86400e6 as doy, hour(ts) + minute(ts) / 60.0 + floor(second(ts)) / 3600.0 as h from events) select event_id, round(sin(2*pi()*doy/365.25), 6) as sin_year, round(cos(2*pi()*doy/365.25), 6) as cos_year, round(sin(4*pi()*doy/365.25), 6) as sin_half, round(cos(4*pi()*doy/365.25), 6) as cos_half, round(sin(2*pi()*h/24), 6) as sin_day, round(cos(2*pi()*h/24), 6) as cos_day from e")
def time_features(spark, d):
    e = table(spark, d, "events")
    return rounded(e.select("event_id", *(c.alias(n) for n, c in columns.time_features(F.col("ts")).items())))


@query("select s_suppkey, round(-abs(s_acctbal) / 100 * sin(radians(s_suppkey * 7 % 360)), 6) + 0.0 as u, round(-abs(s_acctbal) / 100 * cos(radians(s_suppkey * 7 % 360)), 6) + 0.0 as v from supplier")
def wind_from_direction(spark, d):
    u, v = columns.wind_from(F.abs("s_acctbal") / 100, (F.col("s_suppkey") * 7 % 360).cast("double"))
    return rounded(table(spark, d, "supplier").select("s_suppkey", u.alias("u"), v.alias("v"))).select("s_suppkey", (F.col("u") + 0.0).alias("u"), (F.col("v") + 0.0).alias("v"))


@query("with a as (select 37.77 + (i - 7.5) * (50 / 111.32) as lat, 237.58 + (j - 7.5) * (50 / (111.32 * cos(radians(37.77)))) as lon from (select unnest(range(16)) as i), (select unnest(range(16)) as j)) select round((max(lon) - min(lon)) / 15 * 111320 * cos(radians((max(lat) + min(lat)) / 2)), 4) as dx_m, round((max(lat) - min(lat)) / 15 * 111320, 4) as dy_m from a")
def grid_spacing(spark, d):
    from windloom.operators.aggregate import spacing_m

    n = spark.range(16).withColumnRenamed("id", "i")
    lat = n.select(columns.tangent_axis(F.col("i"), 16, 37.77, 50.0).alias("lat"))
    lon = n.select(columns.tangent_axis(F.col("i"), 16, 237.58, 50.0, 37.77).alias("lon"))
    return rounded(spacing_m(lat.crossJoin(lon)), 4)


@query("select s_suppkey, case when s_suppkey * 3.7 - 180 > 180 then s_suppkey * 3.7 - 360 when s_suppkey * 3.7 - 180 < -180 then s_suppkey * 3.7 + 360 else s_suppkey * 3.7 end::double as lon, cast(round_even(s_acctbal / 1000, 0) as bigint) as cell, round((((s_suppkey * 1.5 - 1) % 12.0 + 12.0) % 12.0)::double + 1, 6) as wrapped from supplier")
def coordinate_columns(spark, d):
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey")
    return rounded(s.select("s_suppkey", F.round(columns.wrap_longitude(k * 3.7, 180.0), 6).alias("lon"), columns.whole_displacement(F.col("s_acctbal") / 1000).cast("long").alias("cell"), columns.wrap_cell(k * 1.5, 12).alias("wrapped")))


@query("select cast(i as bigint) as i, cast(j as bigint) as j, round(sqrt((i - 8) ** 2 + (j - 8) ** 2), 6) as euclidean, cast(abs(i - 8) + abs(j - 8) as double) as l1, cast(greatest(abs(i - 8), abs(j - 8)) as double) as linf, case when sqrt((i - 8) ** 2 + (j - 8) ** 2) <= 2 then 0.0 else -1.0 end::double as step_cost, round((10.0 - 0.1) / (1 + 0.1 * sqrt((i - 8) ** 2 + (j - 8) ** 2)), 6)::double as navigation from (select unnest(range(1, 16)) as i), (select unnest(range(1, 16)) as j)")
def reward_grids(spark, d):
    i, j, t = F.col("i"), F.col("j"), (8.0, 8.0)
    return rounded(arena.grid(spark, 15, 15).select("i", "j", *(arena.distance(i, j, t, m).alias(m) for m in ("euclidean", "l1", "linf")), arena.step_cost(i, j, t, 2.0).alias("step_cost"), arena.navigation_reward(i, j, t).alias("navigation")))


@query("with p as (select o_orderkey, o_totalprice / 10000 - 5 as x from orders) select o_orderkey, round(greatest(1.0, least(15.0, x)), 6)::double as clip, x < 1 or x > 15 as out, round(((x - 1) % 15 + 15) % 15 + 1, 6) as periodic from p")
def boundary_modes(spark, d):
    x = F.col("o_totalprice") / 10000 - 5
    (c, out), (p, _) = arena.boundary(x, 15, "clip"), arena.boundary(x, 15, "periodic")
    return rounded(table(spark, d, "orders").select("o_orderkey", c.alias("clip"), out.alias("out"), p.alias("periodic")))


@query("with e as (select user_id, row_number() over (partition by user_id order by ts, event_id) - 1 as step, value, value > 90 as hit, event_id % 4 as segment from events) select user_id, step, max(hit) over w as reached_so_far, round(sum(value) over w, 4) as reward_so_far, count(*) over s as segment_steps, round(sum(value) over s, 4) as segment_reward from e window w as (partition by user_id order by step rows unbounded preceding), s as (partition by user_id, segment order by step rows unbounded preceding)")
def rollout_counters(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").select("user_id", (F.row_number().over(w) - 1).alias("step"), F.col("value").alias("reward"), (F.col("value") > 90).alias("hit"), (F.col("event_id") % 4).alias("segment"))
    out = arena.segment_counters(arena.latched(e, ["user_id"], "hit"), ["user_id"])
    return rounded(out.select("user_id", "step", "reached_so_far", "reward_so_far", "segment_steps", "segment_reward"), 4)


@query("with recursive d(step, i) as (select 0, 1.5::double union all select step + 1, (i - 1 + 0.75) % 10.0 + 1 from d where step < 40) select cast(step as bigint) as step, round(i, 6) as i from d")
def passive_drift(spark, d):
    return rounded(arena.drift(spark, 0.75, 1.5, 10, 40))
