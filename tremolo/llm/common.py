"""Reading the tables and cutting lineage; shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tremolo.llm.tokens import SLICE_BYTES, slices
from tremolo.session import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder (reliable: survives lost executors)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def sha256_of(col) -> F.Column:
    return F.sha2(F.encode(col, "UTF-8"), 256)


def input_bytes(df: DataFrame) -> int:
    """Size of a scan as the optimizer's statistics give it (files on disk; at least 1)."""
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    return max(1, int(str(stats.sizeInBytes())))


def add_columns(df: DataFrame, compute, fields: list[T.StructField], keep_text: bool = True,
                setup=None, limit: int = SLICE_BYTES) -> DataFrame:
    """``df`` with new columns computed from whole texts, one Arrow slice at a time.

    ``compute(slice, state)`` returns an array or list for every name in ``fields``
    (``slice.part`` has the other columns); ``state`` is what ``setup()`` made once per task. Columns of ``df`` that clash with the
    new names are replaced. A slice has at most ``limit`` bytes of text, or one row. ``keep_text=False`` leaves the text out of the result, so that
    it does not travel back from the Python worker.
    """
    new = {f.name for f in fields}
    base = [f for f in df.schema.fields if f.name not in new]
    out = T.StructType([T.StructField(f.name, f.dataType, True) for f in base
                        if keep_text or f.name != "text"] + fields)
    kinds = {f.name: to_arrow_type(f.dataType) for f in fields}
    names = out.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = setup() if setup else None
        for batch in batches:
            for s in slices(batch["text"], limit):
                part = s.part = batch.slice(s.first, s.rows)
                got = compute(s, state)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(got[c], kinds[c]) if c in kinds else part[c] for c in names],
                    names=names)

    return df.select(*[f.name for f in base]).mapInArrow(run, out)
