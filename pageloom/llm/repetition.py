"""Repetition rules by suffix arrays (operator 10).

The words of a batch of documents are sorted as suffixes by prefix doubling, each document apart. The
longest common prefixes of neighbours in that order give, for every word, the longest stretch that begins
there and occurs again in its document; the intervals of equal prefixes are the maximal repeated
substrings, so these stretches cover exactly what the maximal repeats cover. The same array gives the words
in repeated three-word windows.

A document fails when it has few words or many of them in repeated windows; else when too large a share lies
in long repeats or one repeat is too long. Null and empty texts have no words and fail. Repeated rows, null
ids and very long texts get a row each; a long text is sorted on its own, in about 75 bytes a word beside the text, however
often it repeats itself. No documents: no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from io import BytesIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pageloom.llm.common import id_and_text, map_batches

RULED = ("doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
         "base_failed boolean, kept boolean, repeat_share double, longest_repeat bigint")
MIN_WORDS = 50
WINDOW = 3
# The method's own rule: repeats of at least LONG words may cover this share, and none may be longer than that.
LONG = 10
MOST_COVERED = 0.3
LONGEST = 150
# Words sorted at once.
BATCH_WORDS = 400_000
SPACES = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"  # fixed value
CONTINUED = bytes(range(0x80, 0xC0))
IS_SPACE = np.isin(np.arange(256), list(SPACES))


def suffix_array(words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions in suffix order, words that each shares with the one before it); ``ends`` is where each position's document ends.

    ``words`` differ between documents, so no suffix reaches beyond its own. After a step of ``width`` equal
    ranks mean equal stretches of that many words. Only positions whose rank is shared are sorted again, and neighbours
    are measured in the step that parts them: one array of ranks is all that is held.
    """
    n = len(words)
    order = np.argsort(words, kind="stable").astype(np.int32)
    sorted_words = words[order]
    fresh = np.append(True, sorted_words[1:] != sorted_words[:-1])
    del sorted_words
    rank = np.empty(n, np.int32)
    rank[order] = np.flatnonzero(fresh).astype(np.int32)[np.cumsum(fresh, dtype=np.int32) - 1]
    shared, width = np.zeros(n, np.int32), 1
    active = order[~(fresh & np.append(fresh[1:], True))]
    del order
    while len(active):
        after = active + np.int32(width)
        inside = after < ends[active]
        by = rank[active] * np.int64(n + 1)
        by[inside] += rank[after[inside]] + 1
        del after, inside
        sort = np.argsort(by)
        active, by = active[sort], by[sort]
        del sort
        first = rank[active]
        group = np.append(True, first[1:] != first[:-1])
        fresh = np.append(True, by[1:] != by[:-1])
        del by
        at = np.arange(len(active), dtype=np.int32)
        place = first + at - at[group][np.cumsum(group, dtype=np.int32) - 1]
        del first, at
        parted = np.flatnonzero(fresh & ~group)
        shared[place[parted]] = width + shared_on(rank, ends, active[parted - 1], active[parted], width)
        rank[active] = place[fresh][np.cumsum(fresh, dtype=np.int32) - 1]
        width *= 2
        active = active[~(fresh & np.append(fresh[1:], True))]
    order = np.empty(n, np.int32)
    order[rank] = np.arange(n, dtype=np.int32)
    return order, shared


def shared_on(rank: np.ndarray, ends: np.ndarray, a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
    """How many words a and b share after the first ``width``, fewer than as many again: stretches of ``width`` from later
    beginnings stay equal up to there, so halving finds it."""
    more, step = np.zeros(len(a), np.int32), width // 2
    last = len(rank) - 1
    while step:
        x, y = a + more + np.int32(step), b + more + np.int32(step)
        same = (np.maximum(x, y) < ends[a]) & (rank[np.minimum(x, last)] == rank[np.minimum(y, last)])
        more += same * np.int32(step)
        step //= 2
    return more


def longest_again(words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each word, the length of the longest stretch from it that occurs again in its document."""
    if not len(words):
        return np.zeros(0, np.int64)
    kinds = int(words.max()) + 1
    apart = np.repeat(np.arange(len(sizes)) * kinds, sizes)
    apart += words
    order, shared = suffix_array(apart, np.repeat(np.cumsum(sizes).astype(np.int32), sizes))
    best = np.empty(len(words), np.int64)
    best[order] = np.maximum(shared, np.append(shared[1:], 0))
    return best


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Whether each of n words lies in the union of spans."""
    change = np.bincount(starts, minlength=n + 1) - np.bincount(starts + lengths, minlength=n + 1)
    return np.cumsum(change[:n]) > 0


def numbered_words(data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(words of all texts, equal ones by one number; how many each text has), without an object per word."""
    joined = np.frombuffer(b"\n".join(data), np.uint8)
    inside = ~IS_SPACE[joined]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False)).astype(np.int32)
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    offsets = np.append(0, np.cumsum(lengths)).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(joined[inside])])
    text_starts = np.cumsum([0, *(len(d) + 1 for d in data)])
    sizes = np.diff(np.searchsorted(starts, text_starts))
    return words.dictionary_encode().indices.to_numpy(), sizes


def duplicate_lines(data: bytes) -> int:
    """Lines with a word that equal an earlier one."""
    seen, found = set(), 0
    for line in BytesIO(data):
        if not line.isspace():
            line = line.removesuffix(b"\n")
            found += line in seen
            seen.add(line)
    return found


def measures(data: list[bytes], long: int = LONG) -> dict[str, np.ndarray]:
    """The counts of each text, given in UTF-8."""
    flat, sizes = numbered_words(data)
    again, n = longest_again(flat, sizes), len(flat)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    windows = np.flatnonzero(again >= WINDOW)
    repeats = np.flatnonzero(again >= long)
    in_windows = covered(windows, np.full(len(windows), WINDOW), n)
    in_repeats = covered(repeats, again[repeats], n)
    longest = np.zeros(len(sizes), np.int64)
    np.maximum.at(longest, owner, again)
    return {
        "n_words": sizes,
        "word_chars": np.array([len(d.translate(None, SPACES + CONTINUED)) for d in data], np.int64),
        "n_symbols": np.array([len(d) - len(d.translate(None, SYMBOLS)) for d in data], np.int64),
        "n_dup_lines": np.array([duplicate_lines(d) for d in data], np.int64),
        "n_repeat_words": np.bincount(owner[in_windows], minlength=len(sizes)),
        "repeat_words": np.bincount(owner[in_repeats], minlength=len(sizes)),
        "longest_repeat": longest,
    }


def judge(docs: DataFrame, min_words: int = MIN_WORDS, long: int = LONG, most_covered: float = MOST_COVERED,
          longest: int = LONGEST, id_col="doc_id", text_col="text", keep: Sequence[str] = ()) -> DataFrame:
    """One row per document: the counts, whether the base rule failed, and the verdict."""

    def step(batch: pa.RecordBatch) -> dict:
        texts, parts, part, size = batch.column(1).cast(pa.binary()), [], [], 0
        for text in texts:
            part.append(text.as_py())
            size += len(part[-1]) // 6
            if size > BATCH_WORDS:
                parts.append(measures(part, long))
                part, size = [], 0
        if part:
            parts.append(measures(part, long))
        m = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
        share = m.pop("repeat_words") / np.maximum(m["n_words"], 1)
        failed = (m["n_words"] < min_words) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
        kept = ~failed & (share <= most_covered) & (m["longest_repeat"] <= longest)
        return m | {"doc_id": batch.column(0), "base_failed": failed, "kept": kept, "repeat_share": share}

    return map_batches(id_and_text(docs, id_col, text_col, keep), step, RULED, keep)
