"""Quality classifier: gated attention over passages (operator 3).

A text is a bag of passages of about PASSAGE bytes, cut at white space if there is any. A passage is encoded by the
frequencies of pairs of neighbouring character classes, projected to HIDDEN units. Gated attention,
softmax of w . (tanh(V h) * sigmoid(U h)), weighs the passages; the weighted sum is scored by a logistic
unit. Everything is learned from document labels, by Adam, on a bounded sample: at most SAMPLE labelled
documents of each label, those of the smallest hash of their id, weighted back to the labels' shares, and in each at
most FIT_PASSAGES passages, evenly spread: the driver gets no more, however long the texts are. Scoring covers every passage
of every text, some at a time; of a whole text only its hidden units are held.

Null and empty texts are one passage without pairs and get a score too. Repeated rows, null ids and very long
texts get a row each; a document labelled twice counts twice; null labels are ignored. With labels of one kind
only the score is their share, without labels 0.5. No documents: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import held_out, id_and_text, map_batches

SCORED = "doc_id bigint, score double, top_passage int"
PASSAGE = 400
# Bytes after which a passage ends without white space.
LATEST = 200
# Passages encoded at once.
STEP = 4000
HIDDEN = 24
GATE = 12
SAMPLE = 1500
# Passages that are learned from in a labelled text, evenly spread over it: a second bound on the sample. All are scored.
FIT_PASSAGES = 64
EPOCHS = 12
THRESHOLD = 0.7
# Character classes: every group is one; letters that are frequent in many languages stand alone.
GROUPS = [b" ", b"\n", b"\t\r\x0b\x0c", b"0123456789", bytes(range(65, 91)), *(bytes([c]) for c in b"etaoinshr"), b"bcdfgjklmpquvwxyz",
          b".", b",", b"!", b"?", b";:", b"'\"", b"-_", b"()[]{}", b"/\\", b"|", b"#", b"$", b"%", b"&*", b"<>=+@^~`", bytes(range(128, 256))]
CLASSES = len(GROUPS) + 1
CLASS_OF = np.zeros(256, np.uint8)
for _i, _group in enumerate(GROUPS):
    CLASS_OF[list(_group)] = _i + 1
PAIRS = CLASSES * CLASSES


def as_bytes(text: pa.BinaryScalar) -> np.ndarray:
    """A text's bytes, where they lie."""
    return np.frombuffer(text.as_buffer(), np.uint8)


def passages(data: np.ndarray) -> np.ndarray:
    """Where the passages of a text's bytes begin: at the first white space after each PASSAGE bytes, LATEST bytes on if none comes."""
    due = np.arange(PASSAGE, len(data) - PASSAGE // 4, PASSAGE)
    starts = [np.zeros(1, np.int64)]
    for at in range(0, len(due), STEP):
        part = due[at : at + STEP]
        piece = data[part[0] : part[-1] + LATEST]
        spaces = np.append(np.flatnonzero((piece == 32) | (piece == 10)) + part[0], part[-1] + LATEST)
        starts.append(np.minimum(spaces[np.searchsorted(spaces, part)], part + LATEST))
    starts = np.concatenate(starts)
    return starts[starts < max(len(data), 1)]


def encoded(data: np.ndarray, starts: np.ndarray) -> Iterator[np.ndarray]:
    """A row of pair frequencies (square roots, so that rare pairs count) for each passage, at most STEP rows at a time."""
    if len(data) < 2:
        yield np.zeros((1, PAIRS), np.float32)
        return
    bounds = np.append(np.maximum(starts - 1, 0), len(data) - 1)
    for at in range(0, len(starts), STEP):
        part = bounds[at : at + STEP + 1]
        n = len(part) - 1
        kinds = CLASS_OF[data[part[0] : part[-1] + 1]].astype(np.int64)
        owner = np.repeat(np.arange(n), np.diff(part))
        counts = np.bincount(owner * PAIRS + kinds[:-1] * CLASSES + kinds[1:], minlength=n * PAIRS).reshape(-1, PAIRS)
        yield np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1)).astype(np.float32)


def squash(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def hidden(model: dict, x: np.ndarray) -> np.ndarray:
    """The hidden units of encoded passages."""
    return np.tanh(x @ model["E"] + model["e"])


def forward(model: dict, h: np.ndarray, sizes: np.ndarray) -> dict:
    """Scores of bags whose passages' hidden units follow each other in h."""
    starts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(sizes)), sizes)
    t, g = np.tanh(h @ model["V"]), squash(h @ model["U"])
    a = (t * g) @ model["w"]
    a = np.exp(a - np.maximum.reduceat(a, starts)[owner])
    a /= np.add.reduceat(a, starts)[owner]
    z = np.add.reduceat(a[:, None] * h, starts)
    return {"h": h, "t": t, "g": g, "a": a, "z": z, "owner": owner, "score": squash(z @ model["o"] + model["b"])}


def gradients(model: dict, x: np.ndarray, sizes: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
    f = forward(model, hidden(model, x), sizes)
    owner, h, t, g, a = (f[k] for k in ("owner", "h", "t", "g", "a"))
    d = weight * (f["score"] - y) / weight.sum()
    dz = d[:, None] * model["o"]
    per = (dz[owner] * h).sum(1)
    da = a * (per - np.add.reduceat(a * per, np.cumsum(sizes) - sizes)[owner])
    dt, dg = da[:, None] * model["w"] * g * (1 - t * t), da[:, None] * model["w"] * t * g * (1 - g)
    dh = (a[:, None] * dz[owner] + dt @ model["V"].T + dg @ model["U"].T) * (1 - h * h)
    return {"E": x.T @ dh, "e": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ da, "o": f["z"].T @ d, "b": np.array(d.sum())}


def train(bags: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> dict:
    """Adam over batches of 32 bags; the last epochs' mean is the model."""
    rng = np.random.default_rng(seed)

    def drawn(*shape):
        return rng.normal(0, shape[0] ** -0.5, shape).astype(np.float32)

    model = {"E": drawn(PAIRS, HIDDEN) * 3, "e": np.zeros(HIDDEN, np.float32), "V": drawn(HIDDEN, GATE), "U": drawn(HIDDEN, GATE),
             "w": drawn(GATE), "o": drawn(HIDDEN), "b": np.array(0.0)}
    first, second, mean = ({k: np.zeros_like(v) for k, v in model.items()} for _ in range(3))
    step = kept = 0
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), 32):
            part = order[at : at + 32]
            step += 1
            grads = gradients(model, np.concatenate([bags[i] for i in part]), np.array([len(bags[i]) for i in part]), labels[part], weights[part])
            for k, grad in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.999 * second[k] + 0.001 * grad * grad
                model[k] = (model[k] - 0.004 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(model[k].dtype)
            if epoch >= epochs - 3:
                kept += 1
                for k in model:
                    mean[k] = mean[k] + (model[k] - mean[k]) / kept
    return mean


def fit(docs: DataFrame, labels: DataFrame, label: str, folds: int = 4, fold: int = 2, sample: int = SAMPLE, id_col="doc_id", text_col="text") -> dict:
    """Learn from at most ``sample`` documents of each label outside the held-out fold; ``FIT_PASSAGES`` passages of each come to the driver."""
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label).cast("int").alias("label"))
    known = known.filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id", folds, fold))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if len(counts) < 2:
        return {"constant": 0.5 if not counts else float(next(iter(counts)))}
    chosen = [known.filter(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for k in (0, 1)]
    rows = (chosen[0].unionByName(chosen[1])).join(id_and_text(docs, id_col, text_col), "doc_id")

    def sampled(batch: pa.RecordBatch) -> dict:
        drawn = []
        for text in batch.column("text").cast(pa.binary()):
            data = as_bytes(text)
            starts = passages(data)
            ends = np.append(starts[1:], len(data))
            chosen = np.unique(np.linspace(0, len(starts) - 1, FIT_PASSAGES).astype(np.int64)) if len(starts) > FIT_PASSAGES else range(len(starts))
            # Each with the byte before it, whose pair with its first one is the passage's own.
            drawn.append([data[max(starts[k] - 1, 0) : ends[k]].tobytes() for k in chosen])
        return {"doc_id": batch.column("doc_id"), "label": batch.column("label"), "passages": pa.array(drawn, pa.list_(pa.binary()))}

    rows = map_batches(rows.select("doc_id", "label", "text"), sampled, "doc_id bigint, label int, passages array<binary>")
    bags, truth = [], []
    for row in sorted(rows.toLocalIterator(), key=lambda r: (r["doc_id"], r["label"], r["passages"])):
        pieces = [np.frombuffer(p, np.uint8) for p in row["passages"]]
        bags.append(np.concatenate([x for p in pieces for x in encoded(p, np.zeros(1, np.int64))]))
        truth.append(row["label"])
    if len(set(truth)) < 2:
        return {"constant": 0.5 if not truth else float(truth[0])}
    truth = np.array(truth, np.float64)
    share = np.array([counts[0], counts[1]]) / np.array([(truth == 0).sum(), (truth == 1).sum()])
    weights = share[truth.astype(int)]
    return train(bags, truth, weights / weights.mean())


def score(docs: DataFrame, model: dict, id_col="doc_id", text_col="text", keep: Sequence[str] = ()) -> DataFrame:
    """(doc_id, score, top_passage): the passage of the largest attention weight is named by its number."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some tens of kilobytes

    def step(batch: pa.RecordBatch) -> dict:
        model, texts = shared.value, batch.column(1).cast(pa.binary())
        if "constant" in model:
            return {"doc_id": batch.column(0), "score": np.full(len(texts), model["constant"]), "top_passage": np.zeros(len(texts), np.int32)}
        units, held, sizes = [], [], []
        for text in texts:
            data = as_bytes(text)
            starts = passages(data)
            sizes.append(len(starts))
            for x in encoded(data, starts):
                held.append(x)
                if sum(map(len, held)) > STEP:
                    units.append(hidden(model, np.concatenate(held)))
                    held = []
        if held:
            units.append(hidden(model, np.concatenate(held)))
        f = forward(model, np.concatenate(units), np.array(sizes))
        ends = np.cumsum(sizes)
        tops = [int(np.argmax(f["a"][e - n : e])) for e, n in zip(ends, sizes, strict=True)]
        return {"doc_id": batch.column(0), "score": f["score"].astype(np.float64), "top_passage": np.array(tops, np.int32)}

    return map_batches(id_and_text(docs, id_col, text_col, keep), step, SCORED, keep)


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 4, fold: int = 2, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """Fit, then score every document: (doc_id, held_out, score, predicted, top_passage)."""
    scored = score(docs, fit(docs, labels, label, folds, fold, sample))
    return scored.select("doc_id", held_out("doc_id", folds, fold).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"), "top_passage")
