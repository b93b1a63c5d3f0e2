"""The whole job: what grows with the input, crosses a boundary or spans several lines."""

import zlib
from collections import Counter

import numpy as np
import pytest

from pageloom.llm import jaccard, line_chunks, mixing, queries
from pageloom.session import stage, written


@pytest.fixture(scope="module")
def docs(spark, testdata):
    return queries.documents(spark, testdata)


def contexts_of(text):
    """(context of each predictor, byte) of each byte of a text and its end mark, plainly."""
    data, start, last = text.encode() + b"\xff", 0, b""
    for i, byte in enumerate(data):
        yield [*(data[max(i - n, 0) : i] for n in mixing.ORDERS), data[start:i], (last, data[start:i])], byte
        if byte in b" \t\n\x0b\x0c\r":
            last, start = data[start : i + 1], i + 1


def test_mixing_counts_every_context(docs):
    """No two contexts share a count, however many there are."""
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    seen = [Counter() for _ in range(mixing.PREDICTORS)]
    for i, text in rows:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            for contexts, byte in contexts_of(text):
                for p, context in enumerate(contexts):
                    seen[p][context, byte] += 1
    gathered = stage(mixing.prepared(docs, 7, 2).mapInArrow(lambda b: mixing.gather(b, 5), mixing.GATHERED), "gathered")
    n = 0
    for row, counts in mixing.whole_batches(mixing.with_answers(gathered, mixing.answers_of(gathered)).toArrow().to_batches()):
        w = mixing.Beginnings(mixing.unpacked(row["table"], "u1"))
        keys, where = w.keys()
        assert counts.shape == (9, len(keys)) and len(np.unique(keys)) == len(keys)
        texts = bytes(mixing.unpacked(row["table"], "u1")).split(b"\xff")[:-1]
        plain = [x for t in texts for x in contexts_of(t.decode())]
        for p in range(mixing.PREDICTORS):
            assert counts[8][where[p][w.of_byte]].tolist() == [seen[p][contexts[p], byte] for contexts, byte in plain]
        n += len(texts)
    assert n == len(rows)


def test_mixing_stages_texts_without_their_contexts(spark, docs, tmp_path, monkeypatch):
    """Contexts are several times the text and move once; only what the ranges answer is kept beside the batches."""
    staged = {}

    def stage_at(df, label):
        staged[label] = f"{tmp_path}/{label}"
        return written(df, staged[label])

    monkeypatch.setattr(mixing, "stage", stage_at)
    got = mixing.scores(docs).collect()
    text = sum(len((r["text"] or "").encode()) for r in docs.collect())
    rows = spark.read.parquet(staged["gathered"])
    assert len(got) == docs.count() and rows.filter("part is not null").isEmpty()
    assert rows.selectExpr("sum(length(table))").first()[0] < text
    batches = spark.read.parquet(staged["counts"]).select("batch").distinct().count()
    assert batches == rows.count()


def test_mixing_moves_contexts_in_rounds(spark, docs, tmp_path, monkeypatch):
    """Each round moves other contexts and leaves no shuffle behind; together they give what one round does."""
    plain, paths, key = sorted(mixing.scores(docs).collect()), [], "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def stage_at(df, label):
        assert spark.conf.get(key) == "true"
        paths.append(f"{tmp_path}/{label}-{len(paths)}")
        return written(df, paths[-1])

    for name, value in (("stage", stage_at), ("ROUND_BYTES", 0), ("RANGE_BYTES", 10_000), ("SHARES", 1)):
        monkeypatch.setattr(mixing, name, value)
    got = sorted(mixing.scores(docs).collect())
    assert spark.conf.get(key) == "false" and len(got) == len(plain) == docs.count()
    for a, b in zip(got, plain, strict=True):
        assert a[:6] == b[:6] and a["score"] == pytest.approx(b["score"], rel=1e-6)
    rounds = [{r["part"] for r in spark.read.parquet(p).select("part").distinct().collect()} for p in paths if "/counts-" in p]
    assert len(rounds) == mixing.ROUNDS and all(rounds) and sum(map(len, rounds)) == len(set.union(*rounds))


def test_mixing_packs_only_what_a_batch_cannot_know():
    """The counts of any choice of keys come back from what is sent, which is less than nine counts of each."""
    rng = np.random.default_rng(5)
    keys = np.unique(rng.integers(0, 400, 20_000).astype(np.uint64) << np.uint64(40) | rng.integers(0, 256, 20_000).astype(np.uint64))
    counts, which = mixing.answered(keys, rng.integers(0, 400, len(keys)))
    for n in (0, 1, 50, len(keys) // 2, len(keys)):
        some = np.sort(rng.choice(len(keys), n, replace=False))
        sent = mixing.pack_answers(keys[some], counts[:, which[some]])
        assert (mixing.unpack_answers(keys[some], sent) == counts[:, which[some]]).all()
    assert 2 * len(sent) < len(mixing.packed(mixing.byte_planes(counts[:, which].astype("<u4"))))


def test_mixing_packs_many_blocks_at_once(monkeypatch):
    """Small blocks, as there are many of in large corpora, cost no call and no Arrow batch each and hold what they hold alone."""
    rng = np.random.default_rng(9)
    pool = np.unique(rng.integers(0, 60, 5_000).astype(np.uint64) << np.uint64(55) | rng.integers(0, 5, 5_000).astype(np.uint64) << np.uint64(8) | rng.integers(0, 256, 5_000).astype(np.uint64))
    counts, _ = mixing.answered(pool, rng.integers(0, 3, len(pool)))
    blocks = [np.sort(rng.choice(len(pool), n, replace=False)) for n in (1, 700, 2, 1, 1, 300, 5)] + [np.array([9]), np.array([9, 10])]
    at, starts = np.concatenate(blocks), np.append(0, np.cumsum([len(b) for b in blocks]))
    tables = mixing.pack_blocks(pool[at], starts, counts[:, at])
    assert tables == [mixing.pack_answers(pool[b], counts[:, b]) for b in blocks]
    ranges = 1_000
    cuts = mixing.range_starts(pool, ranges)
    tables = [mixing.pack_answers(pool[a:b], counts[:, a:b]) for a, b in zip(cuts, cuts[1:]) if a < b]
    assert len(tables) > 10 and (mixing.unpack_blocks(pool, tables) == counts).all()
    for piece in (1, 500, 1 << 20):
        monkeypatch.setattr(mixing, "PIECE", piece)
        rows = list(mixing.range_rows(4, pool, counts[8], ranges))
        found = [mixing.unpack_counts(t) for r in rows for t in r.column("table").to_pylist()]
        assert (np.concatenate([keys for keys, _ in found]) == pool).all() and (np.concatenate([n for _, n in found]) == counts[8]).all()
        assert [i for r in rows for i in r.column("part").to_pylist()] == np.flatnonzero(np.diff(cuts)).tolist()
        assert len(found) == len(tables) and len(rows) <= 2 * len(pool) // piece + 1


def test_mixing_orders_hashes(monkeypatch):
    """Stable, whether or not the upper bits tell hashes apart."""
    rng = np.random.default_rng(6)
    for high, n in ((1 << 63, 5_000), (200, 5_000), (1 << 40, 1), (7, 0)):
        upper = rng.integers(0, high, n).astype(np.uint64)
        for x in (upper, upper << np.uint64(8) | rng.integers(0, 4, n).astype(np.uint64), upper << np.uint64(20) | rng.integers(0, 3, n).astype(np.uint64) << np.uint64(8)):
            for x in (x, np.append(x, np.uint64((1 << 64) - 1))):
                for tail in (0, 8):
                    assert mixing.ordered(x, tail).tolist() == np.argsort(x, kind="stable").tolist()


def test_mixing_hashes_a_context_once(monkeypatch):
    """Contexts of the last bytes are hashed once a batch however often they occur, and never more than a block of bytes at a time when counted."""
    rng, hashed, plain = np.random.default_rng(7), {p: [] for p in range(mixing.PREDICTORS)}, mixing.Beginnings.hashes

    def hashes(self, p, *some):
        x = plain(self, p, *some)
        hashed[p].append(len(x))
        return x

    monkeypatch.setattr(mixing.Beginnings, "hashes", hashes)
    texts = [" ".join(rng.choice(["ab", "abc", "Ob", "\u00e9t\u00e9", "you", "z", ""], n)) for n in (0, 1, 3, 500, 20_000)]
    data = mixing.joined_bytes(texts)
    keys, _ = mixing.Beginnings(data).keys()
    distinct = [len({(contexts[p], byte) for t in texts for contexts, byte in contexts_of(t)}) for p in range(mixing.PREDICTORS)]
    assert len(keys) == sum(distinct)
    assert [sum(hashed[p]) for p in range(mixing.WORD)] == distinct[: mixing.WORD]
    hashed.update({p: [] for p in hashed})
    counted = mixing.document_of(data) != 3
    every, times = mixing.counted_keys(data, counted, 0, 1 << 32)
    assert (every == keys).all() and times.sum() == mixing.PREDICTORS * counted.sum()
    assert max(hashed[mixing.WORD]) <= max(mixing.BLOCK_BYTES, len(texts[-1].encode()) + 1) and sum(hashed[mixing.WORD]) == len(data)
    assert len(hashed[mixing.WORD]) > 1


def test_mixing_numbers_codes():
    """By a table or by sorting: one of each code, and which of them each is."""
    rng = np.random.default_rng(8)
    for n in (0, 1, 1000):
        for size in (7, 5_000, 1 << 42):
            codes = rng.integers(0, min(size, 60), n) * (size // 60 or 1)
            one_of, number = mixing.numbered(codes, size + size // 60 * 60 + 1)
            assert (codes[one_of][number] == codes).all() and len(one_of) == len(set(codes.tolist()))


def test_mixing_sees_the_words_before(spark):
    """The order of a text's words counts, and phrases that repeat cost less than the same words anew."""
    rng, names = np.random.default_rng(3), [f"{a}{b}" for a in ("ka", "lo", "mi", "su") for b in ("ren", "tal", "vok", "zim", "dar")]
    phrase = " ".join(rng.permutation(names))
    rows = [(i, " ".join(rng.permutation(names)) if i % 2 else phrase) for i in range(60)]
    table = spark.createDataFrame([*rows, (1000, phrase), (1000, " ".join([*reversed(phrase.split()[:-1]), phrase.split()[-1]]))], "doc_id long, text string")
    scores = sorted(r["score"] for r in mixing.scores(table).collect() if r["doc_id"] == 1000)
    assert scores[0] < scores[1] - 5


def plain_runs(rows, min_words):
    """What stays of each text: without the lines in a run of enough words that stands earlier, too, in lines with words."""
    texts, places = sorted(set(rows)), {}
    lines = [[x for x in t.split("\n") if x.split()] for _, t in texts]
    gone = [set() for _ in texts]
    for k, doc in enumerate(lines):
        for i in range(len(doc)):
            for j in range(i + 1, len(doc) + 1):
                if sum(len(x.split()) for x in doc[i:j]) >= min_words:
                    if places.setdefault(tuple(doc[i:j]), (k, i)) != (k, i):
                        gone[k] |= set(range(i, j))
    return {i: [x for n, x in enumerate(doc) if n not in g] for (i, _), doc, g in zip(texts, lines, gone, strict=True)}


def test_line_chunks_take_out_every_repeated_run(spark):
    """Passages of 2 to 20 short lines inside unlike documents, and random texts of few lines, against all runs tried."""
    rng, rows = np.random.default_rng(4), []
    for n in range(2, 21):
        size = max(1, 54 // n)
        passage = [" ".join(f"p{n}x{k}w{w}" for w in range(size)) for k in range(n)]
        for d in range(2):
            own = [[f"own{n}d{d}l{k}{side} a b" for k in range(3)] for side in "ab"]
            rows.append((10 * n + d, "\n".join([*own[0], *passage, *[""] * d, *own[1]])))
    rows += [(1000 + k, "\n".join(rng.choice(["", "one two", "three four five six", "seven", "eight nine " * 4, "ten " * 13], rng.integers(1, 12)))) for k in range(40)]
    got = {r["doc_id"]: r["text"] for r in line_chunks.dedupe(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = plain_runs(rows, line_chunks.MIN_WORDS)
    assert {i: [x for x in t.split("\n") if x.split()] for i, t in got.items()} == want
    assert all("p" not in got[10 * n + 1] for n in range(2, 21) if n * max(1, 54 // n) >= line_chunks.MIN_WORDS)


def test_jaccard_counts_links_once_where_a_block_is_empty(spark, monkeypatch):
    """Pairs whose group gets more blocks than it has members; some pairs fall into one block."""
    monkeypatch.setattr(jaccard, "GROUP_SHINGLES", 50)
    rows = []
    for k in range(15):
        words = [f"g{k}t{n}" for n in range(120)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join([*words[:-1], "edit"]))]
    got = jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r["class_id"], r["n_links"]) for r in sorted(got)] == [(i - i % 2, 1) for i, _ in rows]


@pytest.mark.parametrize("hot_rows", [3, 10**6])
def test_components_of_stars_and_chains(spark, hot_rows):
    """A star's centre, smallest or not, is met in shares; chains and loops as well."""
    edges = [(0, k) for k in range(1, 40)] + [(99, k) for k in range(50, 90)] + [(k, k + 1) for k in range(100, 108)] + [(7, 120), (130, 130), (131, 132), (132, 131)]
    low = {n: n for e in edges for n in e}
    for _ in low:
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
    table = spark.createDataFrame([(a.to_bytes(2, "big"), b.to_bytes(2, "big")) for a, b in edges], "a binary, b binary")
    got = {(int.from_bytes(r["node"], "big"), int.from_bytes(r["root"], "big")) for r in jaccard.components(table, hot_rows).collect()}
    assert got == {pair for pair in low.items() if pair[0] != 130}
