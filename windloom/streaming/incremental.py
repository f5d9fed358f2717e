"""Incremental statistics, ordered ingestion and stateful agents on Structured Streaming.

A stream's checkpoint is its progress file: a stopped run goes on where it was and gives what an uninterrupted
one gives. Late or overlapping input is an error, not silently dropped.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from windloom.operators.aggregate import finite, from_moments
from windloom.operators.temporal import sample_plane

#: Points of a trail that an agent keeps.
TRAIL = 400


def moments(cells: DataFrame, by: str = "level") -> DataFrame:
    cols = []
    for c in ("u", "v"):
        x = F.when(finite(F.col(c).cast("double")), F.col(c).cast("double"))
        cols += [F.sum(x).alias(f"s_{c}"), F.sum(x * x).alias(f"q_{c}"), F.count(x).alias(f"n_{c}")]
    return cells.groupBy(by).agg(*cols)


def streamed_stats(spark: SparkSession, folder: str, schema: str, checkpoint: str, view: str, by: str = "level", files_per_batch: int = 1, max_batches: int | None = None) -> DataFrame:
    """Per-level mean and deviation of all files so far; a second call with the same checkpoint reads only new files.

    Partial moments are kept as files next to the checkpoint, one set a batch, so that a batch that is run again replaces its own.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    parts = f"{checkpoint}/moments"
    done = {"n": 0}

    def keep(batch: DataFrame, number: int) -> None:
        moments(batch, by).coalesce(1).write.mode("overwrite").parquet(f"{parts}/batch={number}")
        done["n"] += 1

    q = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{checkpoint}/stream").trigger(availableNow=True).start()
    if max_batches is None:
        q.awaitTermination()
    else:
        while q.isActive and done["n"] < max_batches:
            q.awaitTermination(0.05)
        q.stop()
    merged = spark.read.parquet(parts).groupBy(by).agg(*(F.sum(f"{m}_{c}").alias(f"{m}_{c}") for c in ("u", "v") for m in "sqn"))
    out = from_moments(merged, [by])
    out.createOrReplaceTempView(view)
    return out


def append_in_order(target: str, time: str = "time") -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that stores a batch sorted by time and refuses one that begins before the end of the earlier ones.

    A batch is the partition ``batch`` of its number: one that is run again after a lost driver replaces its own rows.
    """

    def run(batch: DataFrame, number: int) -> None:
        first = batch.agg(F.min(time)).first()[0]
        if first is None:
            return
        try:
            last = batch.sparkSession.read.parquet(target).where(F.col("batch") < number).agg(F.max(time)).first()[0]
        except Exception as e:  # nothing stored yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            last = None
        if last is not None and first <= last:
            raise ValueError(f"batch {number} begins at {first}, stored data end at {last}")
        batch.repartitionByRange(F.col(time)).sortWithinPartitions(time).write.mode("overwrite").option("compression", "zstd").parquet(f"{target}/batch={number}")

    return run


def months_left(spark: SparkSession, first: str, last: str, stored: DataFrame | None, time: str = "time") -> DataFrame:
    """month: first days of months in [first, last] that aren't stored to their end."""
    months = spark.sql(f"select explode(sequence(date'{first}', date'{last}', interval 1 month)) as month")
    if stored is None:
        return months
    end = stored.agg(F.max(time).alias("end"))
    return months.crossJoin(F.broadcast(end)).where(F.col("end").isNull() | (F.add_months("month", 1).cast("timestamp_ntz") - F.expr("interval 1 hour") > F.col("end"))).select("month")


def windowed_means(events: DataFrame, watermark: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", watermark).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))


#: Chunks of wind that an agent keeps: the oldest go.
CHUNKS = 8
AGENT_OUT = "agent long, n long, t double, y double, x double, u double, v double, level int, waiting boolean, trail int"
AGENT_STATE = "t double, y double, x double, level int, n long, trail array<double>, chunks array<binary>"


class Chunk:
    """Winds (frame, level, y, x) of a box that begins at t0, y0, x0; hours, cells."""

    def __init__(self, t0: float, y0: float, x0: float, u: np.ndarray, v: np.ndarray):
        self.origin, self.u, self.v = (float(t0), float(y0), float(x0)), u, v

    def packed(self) -> bytes:
        return struct.pack("<3d4i", *self.origin, *self.u.shape) + self.u.astype("<f8").tobytes() + self.v.astype("<f8").tobytes()

    @classmethod
    def unpacked(cls, raw: bytes) -> Chunk:
        *origin, frames, levels, ny, nx = struct.unpack_from("<3d4i", raw)
        both = np.frombuffer(raw, "<f8", offset=struct.calcsize("<3d4i")).reshape(2, frames, levels, ny, nx)
        return cls(*origin, *both)

    def holds(self, t: float, y: float, x: float) -> bool:
        frames, _, ny, nx = self.u.shape
        return all(a <= p < a + n - 1 for a, p, n in zip(self.origin, (t, y, x), (frames, ny, nx)))

    def wind(self, level: int, t: float, y: float, x: float) -> tuple[float, float]:
        """Bilinear in space, linear in time, clamped a little before the last frame and line."""
        frames = self.u.shape[0]
        at = min(max(t - self.origin[0], 0.0), frames - 1.001)
        k, part = int(at), at - int(at)
        place = np.array([y - self.origin[1]]), np.array([x - self.origin[2]])
        read = lambda f: (1 - part) * float(sample_plane(f[k, level], *place)[0]) + part * float(sample_plane(f[min(k + 1, frames - 1), level], *place)[0])
        return read(self.u), read(self.v)


def advance(chunks: list[Chunk], t: float, y: float, x: float, level: int, hours: float, metres: tuple[float, float]) -> tuple[float, float, float, float, float] | None:
    """t, y, x after so many hours with the wind at half the way (that at the start where half the way isn't in the chunk), and that wind; None without a chunk here.

    Of several chunks that hold the place the one with the largest t0, then x0, then y0 counts. ``metres``: of a cell in y and x.
    """
    here = [c for c in chunks if c.holds(t, y, x)]
    if not here:
        return None
    chunk = max(here, key=lambda c: (c.origin[0], c.origin[2], c.origin[1]))
    u, v = chunk.wind(level, t, y, x)
    seconds = hours * 3600.0
    half = t + 0.5 * hours, y + 0.5 * v * seconds / metres[0], x + 0.5 * u * seconds / metres[1]
    if chunk.holds(*half):
        u, v = chunk.wind(level, *half)
    return t + hours, y + v * seconds / metres[0], x + u * seconds / metres[1], u, v


def agents(inputs: DataFrame, start: tuple[float, float, float] = (0.0, 0.0, 0.0), level: int = 0, metres: tuple[float, float] = (1000.0, 1000.0)) -> DataFrame:
    """State by agent from a stream of (agent, seq, kind, hours, level, t0, y0, x0, shape, u, v).

    'chunk' adds winds (arrays over frame, level, y, x of ``shape``) to the agent's, of which it keeps CHUNKS; 'tick' moves it
    for ``hours``, or leaves it waiting where it has no chunk; 'control' sets its level. A micro-batch's rows are taken in order of seq.
    """

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        t, y, x, at, n, trail, raw = state.get if state.exists else (*start, level, 0, [], [])
        trail, chunks, wind, waiting = list(trail), [Chunk.unpacked(bytes(c)) for c in raw], (0.0, 0.0), False
        for r in sorted((r for pdf in batches for r in pdf.itertuples(index=False)), key=lambda r: r.seq):
            if r.kind == "control":
                at = int(r.level)
            elif r.kind == "chunk":
                chunks = [*chunks, Chunk(r.t0, r.y0, r.x0, *(np.asarray(f, dtype=float).reshape(tuple(r.shape)) for f in (r.u, r.v)))][-CHUNKS:]
            else:
                moved = advance(chunks, t, y, x, at, float(r.hours), metres)
                waiting = moved is None
                if moved:
                    t, y, x, *wind = moved
                    n, trail = n + 1, [*trail, x, y, t][-3 * TRAIL :]
        state.update((t, y, x, at, n, trail, [c.packed() for c in chunks]))
        yield pd.DataFrame({"agent": [key[0]], "n": [n], "t": [t], "y": [y], "x": [x], "u": [wind[0]], "v": [wind[1]], "level": [at], "waiting": [waiting], "trail": [len(trail) // 3]}).astype({"level": "int32", "trail": "int32"})

    return inputs.groupBy("agent").applyInPandasWithState(step, AGENT_OUT, AGENT_STATE, "update", GroupStateTimeout.NoTimeout)
