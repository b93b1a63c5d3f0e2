"""Removal of repeated line chunks (operator 4).

Boundaries are chosen by content: in every shortest run of lines with MIN_WORDS words, the line whose hash is smallest. They
depend on the lines of the run alone, so wherever a text repeats such a run, however its surroundings shift, it has the same
boundary there. Boundaries that occur once in the whole corpus rule their runs out; they are most, and only their hashes move.
Around the others the chunks are grown line by line, both ways, to MIN_WORDS words; a rolling hash over the line hashes names
each. Chunks are compared byte by byte, by grouping on their bytes. All chunks that an earlier place (by id, text hash and line) has too are
taken out; together they cover every repeated run of at least MIN_WORDS words, however it is broken into lines. The first place of a line
always stays. Lines without words do not count; they go with the line before them (at the start: the one after).

Texts are moved only where they hold a boundary that repeats, and again where something is taken out; a Bloom filter of
bounded size tells which, so that all others are answered where they are.

Null and empty texts stay as they are (empty). Rows that repeat both id and text count as one document and lose the
same chunks. A null id sorts first. Very long texts are rows like others. No documents: no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.bloom import blocks_for, bloom_filter, possible
from pageloom.llm.common import id_and_text, map_batches
from pageloom.session import stage

BOUNDARIES = "at_id bigint, tie bigint, boundary bigint, n bigint"
BODIES = "at_id bigint, tie bigint, line int, n_lines int, chunk bigint, body string"
MIN_WORDS = 12
FACTOR = 0x9E3779B97F4A7C15
LOWEST = -(1 << 63)
MASK = (1 << 64) - 1


def filled(text: str) -> tuple[list[str], list[int], list[int]]:
    """(all lines, places of those that have words, their numbers of words)."""
    lines = text.split("\n")
    words = [len(line.split()) for line in lines]
    return lines, [i for i, n in enumerate(words) if n], [n for n in words if n]


def signed(number: int) -> int:
    return number - (1 << 64) if number >> 63 else number


def cut(text: str, min_words: int = MIN_WORDS) -> tuple[list[int], list[tuple[int, int, int]]]:
    """(hashes of the lines that have words, (first line, end, boundary) of the shortest runs that start or end at a line)."""
    lines, at, words = filled(text)
    hashes, total = [xxhash.xxh3_64_intdigest(lines[i].encode()) for i in at], [0]
    for n in words:
        total.append(total[-1] + n)
    spans, end, start = set(), 0, 0
    for i in range(len(at)):
        while end < len(at) and total[end] - total[i] < min_words:
            end += 1
        if total[end] - total[i] >= min_words:
            spans.add((i, end))
        while total[i + 1] - total[start + 1] >= min_words and start < i:
            start += 1
        if total[i + 1] - total[start] >= min_words:
            spans.add((start, i + 1))
    return hashes, [(start, end, min(range(start, end), key=hashes.__getitem__)) for start, end in sorted(spans)]


def boundaries(text: str, min_words: int = MIN_WORDS) -> Counter:
    """How many places have each boundary."""
    hashes, runs = cut(text, min_words)
    return Counter(signed(hashes[place]) for place in {place for _, _, place in runs})


def chunks_at(text: str, chosen: set[int], min_words: int = MIN_WORDS) -> list[tuple[int, int, int]]:
    """(first line, lines, hash) of the chunks around the ``chosen`` boundaries, in lines that have words."""
    hashes, runs = cut(text, min_words)
    rolled, powers = [0], [1]
    for line in hashes:
        rolled.append((rolled[-1] * FACTOR + line) & MASK)
        powers.append(powers[-1] * FACTOR & MASK)
    return [
        (start, end - start, signed((rolled[end] - rolled[start] * powers[end - start]) & MASK))
        for start, end, place in runs if signed(hashes[place]) in chosen
    ]


def without(text: str, chunks: list[tuple[int, int]]) -> tuple[str, int, int, int]:
    """(what stays without the (first line, lines) ``chunks``, lines, removed lines, removed runs)."""
    lines, at, _ = filled(text)
    if not chunks:
        return text, len(lines), 0, 0
    gone = np.zeros(len(at) + 1, np.int64)
    for start, n in chunks:
        gone[start] += 1
        gone[start + n] -= 1
    gone = np.cumsum(gone[:-1]) > 0
    # Each line without words has the fate of the one before it.
    of_line = np.maximum(np.searchsorted(at, np.arange(len(lines)), "right") - 1, 0)
    removed = gone[of_line]
    stays = [line for line, r in zip(lines, removed.tolist(), strict=True) if not r]
    return "\n".join(stays), len(lines), int(removed.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())


def dedupe(docs: DataFrame, min_words: int = MIN_WORDS, id_col="doc_id", text_col="text", keep: Sequence[str] = ()) -> DataFrame:
    """(doc_id, text, n_lines, removed_lines, removed_chunks) of every document; ``text`` is what stays, ``removed_chunks`` counts the
    runs of lines that went. Other columns to ``keep`` follow."""
    whole = id_and_text(docs, id_col, text_col, keep).withColumns({"at_id": F.coalesce("doc_id", F.lit(LOWEST)), "tie": F.xxhash64("text")})
    whole = whole.withColumn("key", F.xxhash64("at_id", "tie"))

    def bounds(batch: pa.RecordBatch) -> dict | None:
        found = [boundaries(text, min_words) for text in batch.column("text").to_pylist()]
        rows = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
        flat = [pair for f in found for pair in f.items()]
        return {"at_id": batch.column("at_id").take(rows), "tie": batch.column("tie").take(rows),
                "boundary": pa.array([b for b, _ in flat], pa.int64()), "n": pa.array([n for _, n in flat], pa.int64())}

    found = stage(map_batches(whole.select("at_id", "tie", "text"), bounds, BOUNDARIES), "boundaries")
    again = found.groupBy("boundary").agg(F.sum("n").alias("n")).filter("n > 1").select("boundary")
    by_doc = found.join(again, "boundary", "left_semi").groupBy("at_id", "tie").agg(F.collect_set("boundary").alias("found"))
    by_doc = stage(by_doc.withColumn("key", F.xxhash64("at_id", "tie")), "chosen")

    def body(batch: pa.RecordBatch) -> dict:
        rows, flat, bodies = [], [], []
        for row, (text, chosen) in enumerate(zip(batch.column("text").to_pylist(), batch.column("found").to_pylist(), strict=True)):
            lines, at, _ = filled(text)
            for start, n, chunk in chunks_at(text, set(chosen), min_words):
                rows.append(row)
                flat.append((start, n, chunk))
                bodies.append("\n".join(lines[i] for i in at[start : start + n]))
        made = {name: batch.column(name).take(pa.array(rows, pa.int64())) for name in ("at_id", "tie")}
        made |= {name: pa.array([c[k] for c in flat], kind) for k, (name, kind) in enumerate((("line", pa.int32()), ("n_lines", pa.int32()), ("chunk", pa.int64())))}
        return made | {"body": pa.array(bodies, pa.string())}

    asked, _ = told_apart(whole, by_doc)
    holders = asked.select("at_id", "tie", "text").join(by_doc.drop("key"), ["at_id", "tie"])
    bodies = stage(map_batches(holders, body, BODIES), "bodies")
    place = F.struct("at_id", "tie", "line")
    # Grouping by the bytes compares them; equal ones are added up before they move.
    equal = stage(bodies.groupBy("chunk", "body").agg(F.min(place).alias("first"), F.count("*").alias("n")), "equal-chunks")
    clashes = stage(equal.groupBy("chunk").agg(F.count("*").alias("n")).filter("n > 1").select("chunk"), "clashes")
    # One hash, one text: the hash tells the text. Hashes of several texts, if any, are told apart by the text.
    narrow = bodies.drop("body").join(clashes, "chunk", "left_anti")
    sure = narrow.join(equal.filter("n > 1").select("chunk", "first"), "chunk")
    wide = bodies.join(clashes, "chunk", "left_semi").join(equal.filter("n > 1").select("chunk", "body", "first"), ["chunk", "body"]).drop("body")
    repeats = sure.unionByName(wide).filter(place != F.col("first"))
    removed = stage(repeats.groupBy("at_id", "tie").agg(F.collect_set(F.struct("line", "n_lines")).alias("removed")).withColumn("key", F.xxhash64("at_id", "tie")), "removed")

    touched, untouched = told_apart(whole, removed)
    joined = touched.join(removed.drop("key"), ["at_id", "tie"], "left")

    def stays(batch: pa.RecordBatch) -> dict:
        texts, removed = batch.column("text").to_pylist(), batch.column("removed").to_pylist()
        out = [without(text, [(c["line"], c["n_lines"]) for c in chunks or ()]) for text, chunks in zip(texts, removed, strict=True)]
        counts = {name: pa.array([o[k] for o in out], pa.int64()) for k, name in ((1, "n_lines"), (2, "removed_lines"), (3, "removed_chunks"))}
        return {"doc_id": batch.column("doc_id"), "text": pa.array([o[0] for o in out], pa.string())} | counts | {"text_hash": batch.column("tie")}

    id_type = whole.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, text string, n_lines bigint, removed_lines bigint, removed_chunks bigint, text_hash bigint"
    kept = ["kept_columns.*"] if keep else []
    counts = {"n_lines": F.size(F.split("text", "\n")).cast("long"), "removed_lines": F.lit(0).cast("long"), "removed_chunks": F.lit(0).cast("long"), "text_hash": F.col("tie")}
    names = [part.split()[0] for part in schema.split(", ")]
    same = untouched.withColumns(counts).select(*(n for n in names if n not in keep), *kept)
    return map_batches(joined, stays, schema, keep).unionByName(same)


def told_apart(whole: DataFrame, some: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose ``key`` may be among those of ``some``, rows whose key is not)."""
    n_blocks = blocks_for(some.count())
    rows = possible(whole, "key", stage(bloom_filter(some, "key", n_blocks), "bloom"), n_blocks)
    return rows.filter("possible").drop("possible"), rows.filter("NOT possible").drop("possible")
