"""Token ids as flat binary files with 64-bit document offsets (operator 6).

Documents are range-partitioned by id; each task streams the ids of its documents to one flat file of
unsigned integers (16 bits while the vocabulary allows it, else 32) and writes their offsets as 64-bit
integers to a second one. The manifest has a row per file; a prefix sum over its token counts gives
each file's base. A lost or repeated task leaves files that no manifest row names.

Null and empty texts hold the end id only. Rows that repeat an id all count, ordered by a hash of their
text; rows with a null id come first. No documents: no files, no rows.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pageloom.llm.bytebpe import loaded
from pageloom.llm.common import broadcast_file, id_and_text
from pageloom.session import stage, stage_folder

MANIFEST = "part int, ids_file string, offsets_file string, doc_ids array<bigint>, width int, n_docs bigint, n_ids bigint"
ROWS = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


def file_system(uri: str):
    """(file system, path) of a folder in any store that Arrow reads: file, hdfs, s3, gs."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^file:/*", "file:///", uri).replace("s3a://", "s3://"))


def write_tokens(docs: DataFrame, folder: str, tokenizer_json: str, end_id: int, id_col="doc_id", text_col="text") -> DataFrame:
    """Write all documents in ascending id order; returns the manifest."""
    shared = broadcast_file(docs.sparkSession, tokenizer_json)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = file_system(folder)
        system.create_dir(path, recursive=True)
        bpe, name = loaded(shared), uuid.uuid4().hex
        dtype = np.dtype("<u2" if max(bpe.size - 1, end_id) < 1 << 16 else "<u4")
        doc_ids, ends, total = [], [0], 0
        with system.open_output_stream(f"{path}/{name}.ids") as out:
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    ids = np.array([*bpe.encode(text), end_id], dtype)
                    out.write(ids.tobytes())
                    total += len(ids)
                    doc_ids.append(doc_id)
                    ends.append(total)
        if doc_ids:
            with system.open_output_stream(f"{path}/{name}.offsets") as out:
                out.write(np.array(ends, "<i8").tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([f"{name}.ids"]), pa.array([f"{name}.offsets"]),
                 pa.array([doc_ids], pa.list_(pa.int64())), pa.array([dtype.itemsize], pa.int32()),
                 pa.array([len(doc_ids)], pa.int64()), pa.array([total], pa.int64())],
                [part.split()[0] for part in MANIFEST.split(", ")])

    keyed = id_and_text(docs, id_col, text_col).withColumn("tie", F.xxhash64("text"))
    ordered = keyed.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    manifest = stage(ordered.mapInArrow(write, MANIFEST), "manifest")
    # One narrow row per file meets in this window.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = manifest.select("part", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    return manifest.join(bases, "part")


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files, mapped into memory where they are local."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, path = file_system(folder)

        def opened(name):
            return pa.memory_map(f"{path}/{name}") if isinstance(system, fs.LocalFileSystem) else system.open_input_file(f"{path}/{name}")

        for batch in batches:
            for row in batch.to_pylist():
                with opened(row["offsets_file"]) as source:
                    ends = np.frombuffer(source.read_buffer(), "<i8")
                with opened(row["ids_file"]) as source:
                    crcs = []
                    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                        ids = np.frombuffer(source.read_at((b - a) * row["width"], a * row["width"]), f"<u{row['width']}")
                        crcs.append(zlib.crc32(ids.astype("<u4")))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(ends[:-1] + row["base"]), pa.array(np.diff(ends)), pa.array(crcs, pa.int64())],
                    [part.split()[0] for part in ROWS.split(", ")])

    return manifest.repartition(max(1, manifest.count())).mapInArrow(read, ROWS)


def new_folder(spark) -> str:
    return f"{stage_folder(spark)}/tokens-{uuid.uuid4().hex}"
