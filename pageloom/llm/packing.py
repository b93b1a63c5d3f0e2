"""Power-of-two packing (operator 9).

A document's ids are cut into pieces of binary lengths: as many full sequences as fit, then one piece
for each one bit of the rest, longest first. Every piece is a sequence of its own, so no sequence crosses
documents and none is padded; sequences of one length are numbered in a row, by document and start.

Null and empty texts hold the end id only, one piece of length 1. Repeated rows are packed each for itself;
a null id is kept. No documents: no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.bytebpe import loaded
from pageloom.llm.common import broadcast_file, id_and_text, map_batches
from pageloom.operators.skew import number_rows
from pageloom.session import stage

PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def binary_lengths(n: int, longest: int) -> list[int]:
    """Lengths of the pieces of n ids; longest is a power of two."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in reversed(range(longest.bit_length())) if rest >> b & 1]


def pack(docs: DataFrame, tokenizer_json: str, end_id: int, longest: int = 1024, keep_ids: bool = False,
         id_col="doc_id", text_col="text") -> DataFrame:
    """One row per piece: its place in its document and its sequence; with ``keep_ids`` also its ids."""
    if longest & (longest - 1) or longest < 1:
        raise ValueError("the longest sequence must be a power of two")
    shared = broadcast_file(docs.sparkSession, tokenizer_json)
    schema = PIECES + (", ids array<int>" if keep_ids else "")

    def cut(batch: pa.RecordBatch) -> dict:
        bpe = loaded(shared)
        out = {name.split()[0]: [] for name in schema.split(", ")}
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids = np.array([*bpe.encode(text), end_id], "<u4")
            lengths, at, raw = binary_lengths(len(ids), longest), 0, memoryview(ids.tobytes())
            for n in lengths:
                out["start"].append(at)
                out["ids_crc32"].append(zlib.crc32(raw[4 * at : 4 * (at + n)]))
                if keep_ids:
                    out["ids"].append(ids[at : at + n].astype("i4"))
                at += n
            out["length"] += lengths
            out["doc_id"] += [doc_id] * len(lengths)
            out["doc_tokens"] += [at] * len(lengths)
        return {k: pa.array(v, pa.list_(pa.int32()) if k == "ids" else pa.int64()) for k, v in out.items()}

    # Written once: numbering reads its input twice.
    pieces = stage(map_batches(id_and_text(docs, id_col, text_col), cut, schema), "pieces")
    numbered = number_rows(pieces.withColumn("bucket", -F.col("length")), ["bucket", "doc_id", "start"], "sequence_id")
    return numbered.drop("bucket").withColumn("offset", F.lit(0).cast("long"))
