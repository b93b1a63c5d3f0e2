"""Every operator against a plain version, on the smallest tables and on awkward rows."""

import itertools
import math
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from pageloom.llm import bpe, imatch, jaccard, licenses, line_chunks, mixing, packing, quality, queries, repetition, token_files

LOW = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
PASSAGE = " ".join(f"passage{i}" for i in range(60))
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
AWKWARD = [
    (1, None), (2, ""), (3, "one two"), (3, "one two"), (4, LONG), (5, "ID'S <|endoftext|> Été 你好 \U0001f600\x1c x;y\u0085"), (6, PASSAGE + "\nown line here"),
    (7, "other head\n" + PASSAGE), (8, PASSAGE.replace("passage7 ", "changed ")), (None, "no id at all"), (9, " \n\t "), (10, "The MIT License. Licensed under the Apache License; a"),
    (11, "a b c d e " * 40), (-5, "negative id"), (12, "one two"),
]


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, empty, long and repeated texts, with columns whose names the operators use themselves."""
    rows = [(i, t, "x", "kept", "tie", None) for i, t in AWKWARD]
    return spark.createDataFrame(rows, "doc_id long, text string, batch string, kept_columns string, tie string, n int").repartition(3)


@pytest.fixture(scope="module")
def docs(spark, testdata):
    return queries.documents(spark, testdata)


@pytest.fixture(scope="module")
def tables(awkward, docs):
    return [awkward, docs, docs.limit(0)]


def rows_of(df):
    return [(r["doc_id"], r["text"] or "") for r in df.collect()]


def test_bpe(tables):
    path = queries.tokenizer("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    for table in tables:
        want = Counter()
        for i, t in rows_of(table):
            ids = plain.encode(t, add_special_tokens=False).ids
            want[i, len(ids), sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha256(plain.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
        assert Counter(tuple(r) for r in bpe.round_trip(table, path).collect()) == want


def test_token_files(spark, tables):
    path = queries.tokenizer("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    for table in tables:
        folder = token_files.new_folder(spark)
        got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in token_files.read_tokens(token_files.write_tokens(table, folder, path, 2), folder).collect())
        want = Counter()
        for i, t in rows_of(table):
            ids = np.array([*plain.encode(t, add_special_tokens=False).ids, 2], "<u4")
            want[i, len(ids), zlib.crc32(ids)] += 1
        assert Counter(g[1:] for g in got) == want
        order = [g[1] for g in got if g[1] is not None]
        assert order == sorted(order)
        assert [g[0] for g in got] == [0, *itertools.accumulate(g[2] for g in got)][: len(got)]


def test_packing(tables):
    path = queries.tokenizer("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    for table in tables:
        pieces = packing.pack(table, path, 0, 64).collect()
        assert all(r["length"] & (r["length"] - 1) == 0 and r["length"] <= 64 and r["offset"] == 0 for r in pieces)
        assert sorted(r["sequence_id"] for r in pieces) == list(range(1, len(pieces) + 1))
        want = Counter()
        for i, t in rows_of(table):
            ids, at = np.array([*plain.encode(t, add_special_tokens=False).ids, 0], "<u4"), 0
            for n in packing.binary_lengths(len(ids), 64):
                want[i, at, n, zlib.crc32(ids[at : at + n].copy()), len(ids)] += 1
                at += n
            assert at == len(ids)
        assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in pieces) == want


def test_licenses(tables):
    words = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for table in tables:
        want = Counter()
        for i, t in rows_of(table):
            w = words.findall(t.translate(LOW))
            found = [(at, label) for phrase, label in licenses.PHRASES.items() for at in range(len(w)) if w[at : at + len(phrase.split())] == phrase.split()]
            want[i, len(w), len(found), min(found, default=(None,))[0], max(found, default=(None,))[0], ",".join(sorted({x for _, x in found}))] += 1
        got = licenses.scan(table).collect()
        assert Counter(tuple(r)[:6] for r in got) == want
        assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in got)


def test_template_regions():
    machine = licenses.Automaton({"x": "alpha <<optional>> beta gamma <<end>> delta <<any 2>> omega"})
    for text, fits in {"alpha delta omega": 1, "alpha beta gamma delta p q omega": 1, "alpha beta delta omega": 0, "alpha delta p q r omega": 0}.items():
        assert len(machine.places(licenses.words_of(text))[0]) == fits


def plain_repeats(words):
    """For each word the longest stretch from it that occurs again: each place with each other of that word."""
    best, places = [0] * len(words), defaultdict(list)
    for k, w in enumerate(words):
        places[w].append(k)
    for same in places.values():
        for i, j in itertools.combinations(same, 2):
            n = next(n for n in itertools.count() if j + n >= len(words) or words[i + n] != words[j + n])
            best[i], best[j] = max(best[i], n), max(best[j], n)
    return best


def test_repetition(tables):
    words = re.compile(r"[^\x20\x09-\x0D]+")
    for table in tables:
        want = Counter()
        for i, t in rows_of(table):
            w = words.findall(t)
            seen = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
            again = {k + d for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for d in range(3)}
            lines = [x for x in t.split("\n") if words.search(x)]
            failed = len(w) < 50 or 100 * len(again) > 50 * len(w)
            best = plain_repeats(w)
            inside = {k + d for k, n in enumerate(best) if n >= repetition.LONG for d in range(n)}
            share, longest = len(inside) / max(len(w), 1), max(best, default=0)
            kept = not failed and share <= repetition.MOST_COVERED and longest <= repetition.LONGEST
            want[i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again), failed, kept, share, longest] += 1
        got = repetition.judge(table).collect()
        assert Counter(tuple(r) for r in got) == want


def test_longest_repeats():
    rng = np.random.default_rng(1)
    sizes = np.array([0, 1, 40, 3, 60])
    words = rng.integers(0, 3, sizes.sum())
    got, at = repetition.longest_again(words, sizes), 0
    for n in sizes:
        w = words[at : at + n].tolist()
        for i in range(n):
            want = max((next((k for k in itertools.count() if max(i, j) + k >= n or w[i + k] != w[j + k])) for j in range(n) if j != i), default=0)
            assert got[at + i] == want
        at += n


def test_quality(spark, tables, testdata):
    labels = spark.read.parquet(f"{testdata}/labels.parquet")
    scored = {r["doc_id"]: r for r in quality.classify(tables[1], labels).collect()}
    truth = [(scored[r["doc_id"]]["predicted"], r["quality"]) for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert sum(a == b for a, b in truth) >= 0.85 * len(truth)
    model = quality.fit(tables[1], labels, "quality")
    assert [len(quality.score(t, model).collect()) for t in tables] == [len(AWKWARD), tables[1].count(), 0]
    assert all(0 <= r["score"] <= 1 for r in quality.score(tables[0], model).collect())
    assert quality.fit(tables[1], labels.limit(0), "quality") == {"constant": 0.5}


def test_quality_passages():
    """Every pair of neighbouring bytes is counted in one passage, whose ends are at white space or LATEST bytes on."""
    for text in (LONG.encode(), b"x" * 5000, b"", b"a", "\u4f60".encode() * 3000, (PASSAGE + "\n").encode() * 9, b" " * 2000):
        data = np.frombuffer(text, np.uint8)
        starts = quality.passages(data)
        ends = [*starts[1:].tolist(), len(data)]
        assert starts[0] == 0 and all(b - a <= quality.PASSAGE * 5 // 4 + quality.LATEST for a, b in zip(starts.tolist(), ends, strict=True))
        assert all(text[s : s + 1] in b" \n" or not set(text[s // 400 * 400 : s]) & set(b" \n") for s in starts.tolist())
        rows = np.concatenate(list(quality.encoded(data, starts)))
        assert len(rows) == len(starts)
        for k, (a, b) in enumerate(zip(starts.tolist(), ends, strict=True)):
            kinds = quality.CLASS_OF[data[max(a - 1, 0) : b]].tolist()
            want = Counter(x * quality.CLASSES + y for x, y in itertools.pairwise(kinds))
            got = {int(i): float(rows[k, i]) ** 2 for i in np.flatnonzero(rows[k])}
            assert got == pytest.approx({i: c / want.total() for i, c in want.items()}, rel=1e-5)


def test_long_texts_in_bounded_memory():
    """Peak bytes of numpy's arrays for a long text: per word for suffix arrays, per step and hidden unit for passages."""
    tracemalloc.start()
    words = 400_000
    m = repetition.measures([b"ab cd ef gh ij " * (words // 5)])
    assert m["longest_repeat"][0] == words - 5 and m["repeat_words"][0] == words
    assert tracemalloc.get_traced_memory()[1] < 130 * words
    data = np.frombuffer(b"some words of a long text " * 400_000, np.uint8)
    tracemalloc.reset_peak()
    held = tracemalloc.get_traced_memory()[0]
    assert sum(map(len, quality.encoded(data, quality.passages(data)))) == len(quality.passages(data))
    assert tracemalloc.get_traced_memory()[1] - held < 110 * quality.STEP * 1000
    tracemalloc.stop()


def test_quality_gradients():
    rng = np.random.default_rng(2)
    model = {k: rng.normal(0, 0.3, s) for k, s in {"E": (quality.PAIRS, 5), "e": (5,), "V": (5, 4), "U": (5, 4), "w": (4,), "o": (5,), "b": ()}.items()}
    model["b"] = np.array(float(model["b"]))
    x, sizes, y, weight = rng.random((6, quality.PAIRS)) / 30, np.array([1, 3, 2]), np.array([0.0, 1.0, 1.0]), np.array([1.0, 2.0, 1.0])

    def loss():
        p = quality.forward(model, quality.hidden(model, x), sizes)["score"]
        return -(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / weight.sum()

    grads = quality.gradients(model, x, sizes, y, weight)
    for k in ("e", "V", "U", "w", "o"):
        at = tuple(0 for _ in model[k].shape)
        model[k][at] += 1e-6
        up = loss()
        model[k][at] -= 2e-6
        slope = (up - loss()) / 2e-6
        model[k][at] += 1e-6
        assert grads[k][at] == pytest.approx(slope, abs=1e-7)


def test_line_chunks(tables):
    got = {(r["doc_id"], r["n_lines"]): r for r in line_chunks.dedupe(tables[0]).collect()}
    assert got[6, 2]["text"] == PASSAGE + "\nown line here" and got[7, 2]["text"] == "other head" and got[7, 2]["removed_chunks"] == 1
    for table in tables:
        texts = defaultdict(list)
        for i, t in rows_of(table):
            texts[i].append(t)
        rows = line_chunks.dedupe(table).collect()
        assert len(rows) == sum(map(len, texts.values()))
        # What stays is a subsequence of lines; every long line stays somewhere, and once.
        for r in rows:
            assert any(all(x in it for x in r["text"].split("\n")) for t in texts[r["doc_id"]] for it in [iter(t.split("\n"))]) or r["text"] == ""
        kept = Counter(x for r in rows for x in r["text"].split("\n") if len(x.split()) >= 30)
        assert set(kept) == {x for ts in texts.values() for t in ts for x in t.split("\n") if len(x.split()) >= 30}
        assert all(n == 1 for n in kept.values())


def plain_links(rows):
    def grams(t):
        w = t.split()
        return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()

    sets, links, parent = [grams(t) for _, t in rows], Counter(), list(range(len(rows)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    places = defaultdict(list)
    for k, s in enumerate(sets):
        for g in s or ["none"]:
            places[g].append(k)
    for a, b in {p for group in places.values() for p in itertools.combinations(group, 2)}:
        common = len(sets[a] & sets[b])
        if not sets[a] and not sets[b] or common and common >= 0.8 * (len(sets[a]) + len(sets[b]) - common) - 1e-9:
            links[a] += 1
            links[b] += 1
            parent[find(a)] = find(b)
    # Rows in order of id (null last), then of the text's hash as a signed number.
    def key(k):
        tie = xxhash.xxh64_intdigest(rows[k][1], 42)
        return (math.inf if rows[k][0] is None else rows[k][0], tie - (tie >> 63 << 64))

    first, copy = {}, {}
    for k, s in enumerate(sets):
        first[find(k)] = min(first.get(find(k), key(k)), key(k))
        copy[s] = min(copy.get(s, math.inf), key(k)[0])

    def named(i):
        return None if i == math.inf else i

    return Counter((i, named(first[find(k)][0]), links[k], named(copy[sets[k]]), key(k) == first[find(k)]) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize("block", [256, 4])
def test_jaccard(spark, awkward, docs, monkeypatch, block):
    """Also with blocks so small that groups are split."""
    monkeypatch.setattr(jaccard, "BUCKET_BLOCK", block)
    monkeypatch.setattr(jaccard, "GROUP_BLOCK", block)
    base = [f"t{k}" for k in range(120)]
    near = [(1000 + k, " ".join([*base[: 5 * k], f"edit{k}", *base[5 * k + 1 :]])) for k in range(20)]
    group = spark.createDataFrame(near, "doc_id long, text string")
    for table in ([group] if block == 4 else [awkward, docs, docs.limit(0)]):
        got = Counter((r["doc_id"], r["class_id"], r["n_links"], r["copy_of"], r["is_first"]) for r in jaccard.classes(table).collect())
        assert got == plain_links(rows_of(table))


def test_imatch(tables):
    for table in tables:
        rows = [r for r in rows_of(table)]
        if len({i for i, _ in rows}) < len(rows):  # for rows that repeat an id the order is a hash's
            assert len(imatch.compared(table).collect()) == len(rows)
            continue
        rows.sort(reverse=True)
        got = {r["doc_id"]: r for r in imatch.compared(table).collect()}
        assert len(got) == len(rows)
        by_text = defaultdict(set)
        for k, (i, t) in enumerate(rows):
            follow, half = rows[(k + 1) % len(rows)][1], len(t) // 2
            assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (len(t), sha256((t[: len(t) - half] + follow[:half]).encode()).hexdigest())
            assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
            by_text[t].add(got[i]["fingerprint"])
        assert all(len(v) == 1 for v in by_text.values())


def test_mixing(tables):
    words = re.compile(r"[^\x20\x09-\x0D]+")
    for table in tables:
        rows = [(i, words.findall(t.translate(LOW))) for i, t in rows_of(table)]
        train = [w for i, w in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
        counts = Counter(x for w in train for x in w)
        n, v = sum(counts.values()) + len(train), len(counts) + bool(train)
        want = defaultdict(list)
        for i, w in rows:
            score = sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w) + math.log10((len(train) + 1) / (n + v + 1))
            want[i].append((len(w) + 1, sum(x in counts for x in w) + bool(train), n, pytest.approx(score, rel=1e-9)))
        got = mixing.scores(table).collect()
        assert len(got) == len(rows)
        assert all((r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) in want[r["doc_id"]] and r["score"] < 0 for r in got)
        if len(rows) > 100:
            assert np.mean([r["bits_per_byte"] for r in got if r["held_out"]]) < 4


def test_pipeline(spark, testdata):
    docs, kept = queries.documents(spark, testdata), []
    for name, step in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stage(step(spark, docs, testdata), "step")
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS
            kept.append(docs.count())
    assert kept == sorted(kept, reverse=True) and kept[0] > 100
    assert docs.count() == corpus_pipeline.run(spark, testdata).count() > 0
    assert public_tokenizers.path("byte_bpe_50k.json")
