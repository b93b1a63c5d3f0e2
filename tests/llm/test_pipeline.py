"""Every stage of the pipeline row by row against a plain version, each on what the stage before it kept."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from pageloom.llm import line_chunks, quality, queries
from tests.llm.test_operators import plain_links, rows_of
from tests.llm.test_whole import plain_runs


def whole(df):
    return Counter(tuple(r) for r in df.select(*corpus_pipeline.COLUMNS).collect())


def test_stages_row_by_row(spark, testdata):
    steps = dict(corpus_pipeline.STAGES)
    docs = queries.documents(spark, testdata)

    def run(name, docs):
        return corpus_pipeline.stage(steps[name](spark, docs, testdata), "step")

    # The classifier drops whole rows: those it scores below the threshold.
    scored = quality.classify(docs, spark.read.parquet(f"{testdata}/labels.parquet")).collect()
    good = {r["doc_id"] for r in scored if r["score"] >= quality.THRESHOLD}
    first = run("quality classifier", docs)
    assert whole(first) == Counter({row: n for row, n in whole(docs).items() if row[0] in good}) and 0 < first.count() < docs.count()

    # The rules drop whole rows, and at least those that the plain limits reject.
    second = run("quality rules", first)
    kept = whole(second)
    assert not kept - whole(first)
    for row in whole(first):
        words = (row[1] or "").split()
        windows = defaultdict(list)
        for k in range(len(words) - 2):
            windows[tuple(words[k : k + 3])].append(k)
        twice = {k + d for at in windows.values() if len(at) > 1 for k in at for d in range(3)}
        if len(words) < 50 or 100 * len(twice) > 50 * len(words):
            assert row not in kept

    # Line dedup keeps every row and takes out repeated runs of lines.
    third = run("line dedup", second)
    want = plain_runs(rows_of(second), line_chunks.MIN_WORDS)
    made = third.collect()
    assert {r["doc_id"]: [x for x in r["text"].split("\n") if x.split()] for r in made} == want
    others = {r["doc_id"]: (r["lang"], r["source"]) for r in second.collect()}
    assert all((r["lang"], r["source"]) == others[r["doc_id"]] and r["n_chars"] == len(r["text"]) for r in made) and len(made) == len(others)

    # Of each class of near duplicates one whole row stays.
    fourth = run("n-gram Jaccard join", third)
    groups = defaultdict(list)
    for (i, group, *_), n in plain_links(rows_of(third)).items():
        groups[group] += [i] * n
    stay = Counter(r["doc_id"] for r in fourth.collect())
    assert set(stay.values()) == {1} and sorted(sum(i in stay for i in ids) for ids in groups.values()) == [1] * len(groups) and len(stay) == len(groups)
    assert not whole(fourth) - whole(third)

    # Packing holds every id of every row once, in order.
    tokens = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    pieces = defaultdict(list)
    for r in run("packing", fourth).collect():
        pieces[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
    for i, text in rows_of(fourth):
        ids = np.array([*tokens.encode(text, add_special_tokens=False).ids, corpus_pipeline.END_ID], "<u4")
        at = 0
        for start, length, crc, total in sorted(pieces.pop(i)):
            assert (start, total, crc) == (at, len(ids), zlib.crc32(ids[start : start + length]))
            at += length
        assert at == len(ids)
    assert not pieces


def test_awkward_rows_pass_all_stages(spark, testdata):
    """Nulls in every column, empty and repeated rows, extra columns; an empty table gives an empty one."""
    text = " ".join(f"word{k}" for k in range(80)) + "\nand a last line"
    rows = [(None, None, None, None, None), (1, text, "en", None, 3), (1, text, "en", None, 3), (2, "", None, "s", 0), (3, text, None, "s", None), (None, text, "de", "s", 1), (4, text + " more", None, None, None)]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, kept_columns string, key int")
    for start in (table, table.limit(0)):
        docs = start
        for name, step in corpus_pipeline.STAGES:
            labelled = corpus_pipeline.stage(step(spark, docs, testdata), "step")
            if name != "packing":
                assert labelled.columns == corpus_pipeline.COLUMNS and labelled.count() <= docs.count()
            docs = labelled
        assert start.isEmpty() <= docs.isEmpty()
