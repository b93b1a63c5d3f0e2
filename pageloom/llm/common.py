"""What several operators of this folder share."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Text in which Python's character classes, the tokenizers library and its faster twin agree for
# certain: ASCII (without the four separators that only Python calls white space), Latin letters, a
# little punctuation. Other texts go to the library itself.
UNUSUAL = re.compile("[^\x00-\x1b\x20-\u02ff\u2010-\u2027\u20ac]")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """Only (doc_id, text), whatever else ``docs`` holds; a null text counts as empty.

    Columns to ``keep`` follow as they are in one struct, under names that clash with nothing.
    """
    kept = [F.struct(*(F.col(c) for c in keep)).alias("kept_columns")] if keep else []
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *kept)


def map_batches(df: DataFrame, step: Callable[[pa.RecordBatch], dict | None], schema: str, keep: Sequence[str] = ()) -> DataFrame:
    """Run ``step`` on every Arrow batch; it returns the new columns by name.

    Columns that ``id_and_text`` kept come back too; new ones give way to kept ones of the same name.
    """
    names = [part.split()[0] for part in schema.split(", ")]
    if keep:
        kept_type = df.schema["kept_columns"].dataType.simpleString()

        def with_kept(batch: pa.RecordBatch) -> dict | None:
            made = step(batch)
            return made if made is None else made | {"kept_columns": batch.column("kept_columns")}

        made = map_batches(df, with_kept, f"{schema}, kept_columns {kept_type}")
        return made.select(*(n for n in names if n not in keep), "kept_columns.*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (made := step(batch)) is not None:
                yield pa.RecordBatch.from_arrays([made[n] if isinstance(made[n], pa.Array) else pa.array(made[n]) for n in names], names)

    return df.mapInArrow(run, schema)


def held_out(id_col: str, folds: int, fold: int) -> Column:
    """Whether crc32 of the id written as text falls in the fold that no model learns from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))


def broadcast_file(spark: SparkSession, path: str):
    """A vocabulary file's bytes, for every executor; such files have a few megabytes."""
    return spark.sparkContext.broadcast(Path(path).read_bytes())
