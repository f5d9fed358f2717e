import numpy as np
import pytest
from pyspark.sql import functions as F

from windloom.operators.aggregate import norm_stats
from windloom.streaming import incremental


def test_resumed_stats_equal_one_pass(spark, tmp_path):
    rows = [(49 + k % 2, float(k % 17), float(-k % 5)) for k in range(400)]
    df = spark.createDataFrame(rows, "level int, u double, v double")
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    how = (str(tmp_path / "in"), "level int, u double, v double", str(tmp_path / "ck"), "resumed")
    incremental.streamed_stats(spark, *how, max_batches=1)
    got = {r["level"]: r for r in incremental.streamed_stats(spark, *how).collect()}
    for r in norm_stats(df).collect():
        assert got[r["level"]]["mean_u"] == pytest.approx(r["mean_u"], rel=1e-6) and got[r["level"]]["std_v"] == pytest.approx(r["std_v"], rel=1e-6)


def test_append_refuses_overlap(spark, tmp_path):
    put = incremental.append_in_order(str(tmp_path / "out"))
    batch = lambda a, b: spark.sql(f"select explode(sequence(timestamp_ntz'2023-01-01 {a:02d}:00:00', timestamp_ntz'2023-01-01 {b:02d}:00:00', interval 1 hour)) as time")
    put(batch(0, 3), 0)
    put(batch(4, 6), 1)
    with pytest.raises(ValueError, match="stored data end"):
        put(batch(6, 8), 2)
    put(batch(4, 6), 1)  # run again after a lost driver
    assert spark.read.parquet(str(tmp_path / "out")).count() == 7


def test_months_left(spark):
    stored = spark.sql("select timestamp_ntz'2023-02-28 23:00:00' as time")
    assert [str(r["month"]) for r in incremental.months_left(spark, "2023-01-01", "2023-04-01", stored).orderBy("month").collect()] == ["2023-03-01", "2023-04-01"]


def test_agents_move_and_obey(spark, tmp_path):
    """A constant wind on level 1, none on level 0; then no chunk holds the place and the agent waits."""
    shape = (4, 2, 12, 12)
    u = [0.0] * 144 + [10.0] * 144
    chunk = (1, 0, "chunk", None, None, 0.0, 0.0, 0.0, list(shape), u * 4, [0.0] * 1152)
    rows = [chunk, (1, 1, "tick", 0.1, *[None] * 7), (1, 2, "control", None, 1, *[None] * 6), (1, 3, "tick", 0.1, *[None] * 7), (2, 4, "tick", 0.1, *[None] * 7)]
    schema = "agent long, seq long, kind string, hours double, level int, t0 double, y0 double, x0 double, shape array<int>, u array<double>, v array<double>"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    out = incremental.agents(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), start=(0.0, 2.0, 2.0))
    q = out.writeStream.format("memory").queryName("agents_out").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    r = spark.sql("select * from agents_out").where(F.col("agent") == 1).first()
    assert (round(r["x"], 6), r["y"], r["level"], r["n"], r["trail"], r["u"], r["waiting"]) == (5.6, 2.0, 1, 2, 2, 10.0, False)
    assert spark.sql("select * from agents_out").where(F.col("agent") == 2).first()["waiting"]


def test_agents_take_the_wind_half_way():
    u = np.broadcast_to(np.arange(12.0), (4, 1, 12, 12))
    c = incremental.Chunk(0, 0, 0, u, np.zeros_like(u))
    c = incremental.Chunk.unpacked(c.packed())
    t, y, x, *wind = incremental.advance([c], 0.0, 3.0, 2.0, 0, 0.5, (1800.0, 1800.0))
    assert wind == [3.0, 0.0] and (t, y, x) == (0.5, 3.0, 5.0)  # u = x: half a step from 2 is 3
    assert incremental.advance([c], 0.0, 3.0, 9.0, 0, 0.5, (1800.0, 1800.0))[3] == 9.0  # half the way is outside
    assert incremental.advance([c], 3.0, 3.0, 9.0, 0, 0.5, (1800.0, 1800.0)) is None
