"""What the corpus operators share: checkpoints, batches for Python, crc32 folds and span digests."""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows handed to Python at once. Small, because a text may be megabytes long.
ROWS_PER_BATCH = 512


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir, or the context's own; a temporary one on a single machine where neither is set (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if path is None and known.isDefined():
        path = known.get()
    if path is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="windloom-")
    if not known.isDefined():
        spark.sparkContext.setCheckpointDir(path)
    return path


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder; survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_batches(df: DataFrame, make: Callable[[], Callable[[dict[str, list]], dict[str, Sequence]]], schema: str) -> DataFrame:
    """Apply a function of columns to columns, batch by batch.

    ``make`` runs once per task and returns the function, so tables it builds are built once.
    """
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    names = list(df.columns)
    out = _arrow_schema(spark, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            cols = {n: batch.column(i).to_pylist() for i, n in enumerate(names)}
            got = f(cols)
            yield pa.RecordBatch.from_arrays([pa.array(got[c.name], type=c.type) for c in out], schema=out)

    return df.mapInArrow(run, schema)


def _arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema) if isinstance(schema, str) else schema)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; null ids are in no fold (null)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def held_out(doc_id: Column) -> Column:
    return F.coalesce(fold(doc_id) == 2, F.lit(False))


def spans_text(spans: Sequence[tuple[str, int, int]], kinds: Sequence[str]) -> str:
    """kind:start:end by start, then kind in the order given, comma-joined."""
    order = {k: i for i, k in enumerate(kinds)}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], order[s[0]], s[2])))


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def text_key(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Column:
    """A key of a row's id and text; equal rows share it, which is harmless for anything derived from the text."""
    return F.struct(F.xxhash64(F.col(id_col), F.col(text_col)).alias("h"), F.coalesce(F.length(text_col), F.lit(-1)).alias("n"))
