"""Speculate-and-verify BPE with word ends (operator 1).

Every new word of a batch is first cut by greedy longest match over the vocabulary. That is right exactly
when each adjacent pair of tokens is compatible, i.e. when BPE over the two tokens' joined text gives them
back; all pairs of a batch are tested at once against the pairs judged so far. Only words with an
incompatible pair are merged step by step. Words already seen by a Python worker come from its cache,
which is emptied when it is full, so memory stays bounded.

Null and empty texts have no tokens; both hashes are then those of nothing. Repeated rows, null ids and
very long texts get a row each. Texts with unusual characters or special tokens go to the library itself.
"""

from __future__ import annotations

import json
import re
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pageloom.llm.bytebpe import byte_alphabet
from pageloom.llm.common import UNUSUAL, broadcast_file, id_and_text, map_batches

ENCODED = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
# Words kept by a worker, and token pairs judged by it.
CACHED_WORDS = 300_000
CACHED_PAIRS = 2_000_000
# The split pattern of word-end BPE files of this kind (fixed value), with Python's classes; they agree on usual text.
WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_\u00b2\u00b3\u00b9\u00bc-\u00be]+|[\d\u00b2\u00b3\u00b9\u00bc-\u00be]|(?:[^\s\w]|_)+")
_LOADED: dict[int, "WordBpe"] = {}


class WordBpe:
    def __init__(self, data: bytes):
        from tokenizers import Tokenizer

        spec = json.loads(data)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab = model["vocab"]
        self.ranks = {tuple(m): i for i, m in enumerate(model["merges"])}
        self.exact = Tokenizer.from_buffer(data)
        self.exact.no_truncation()
        self.exact.no_padding()
        self.added = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]) or r"(?!)")
        self.names = {i: t for t, i in self.vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.letters = str.maketrans({b: c for c, b in byte_alphabet().items()})
        # Greedy matching may only propose tokens that their own text encodes to.
        sound = {t: i for t, i in self.vocab.items() if self.merged(self.symbols(t)) == [t]}
        end = len(self.suffix)
        self.ends = {t[:-end]: i for t, i in sound.items() if end and t.endswith(self.suffix)}
        self.inner = {t: i for t, i in sound.items() if not (end and t.endswith(self.suffix))}
        self.longest = max(map(len, [*self.ends, *self.inner]))
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, tuple[bytes, str]] = {}

    def symbols(self, token: str) -> list[str]:
        """The characters of a token's text, the word end joined to the last."""
        if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix):
            body = list(token[: -len(self.suffix)])
            return [*body[:-1], body[-1] + self.suffix]
        return list(token)

    def merged(self, parts: list[str]) -> list[str]:
        """Exact merging: always the pair of lowest rank, the leftmost first."""
        ranks, never = self.ranks, len(self.ranks)
        while len(parts) > 1:
            scores = [ranks.get(pair, never) for pair in zip(parts, parts[1:], strict=False)]
            best = min(scores)
            if best == never:
                break
            out, i = [], 0
            while i < len(parts):
                if i < len(scores) and scores[i] == best:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def proposed(self, word: str) -> list[int] | None:
        """Greedy longest match, the last token one that ends a word."""
        n, at, out = len(word), 0, []
        inner, ends, longest = self.inner.get, self.ends.get, self.longest
        while at < n:
            if n - at <= longest and (found := ends(word[at:])) is not None:
                out.append(found)
                return out
            for stop in range(min(n - 1, at + longest), at, -1):
                if (found := inner(word[at:stop])) is not None:
                    break
            else:
                return None
            out.append(found)
            at = stop
        return out

    def compatible(self, keys: np.ndarray) -> np.ndarray:
        """For pairs (first << 32 | second): whether BPE over the joined texts gives the pair back."""
        unique, place = np.unique(keys, return_inverse=True)
        if len(self.pairs) > CACHED_PAIRS:
            self.pairs.clear()
        judged = np.empty(len(unique), bool)
        for i, key in enumerate(unique.tolist()):
            known = self.pairs.get(key)
            if known is None:
                a, b = self.names[key >> 32], self.names[key & 0xFFFFFFFF]
                known = self.pairs[key] = self.merged(self.symbols(a + b)) == [a, b]
            judged[i] = known
        return judged[place]

    def learn(self, new: list[str]) -> None:
        """Put the ids and the decoded text of new words in the cache."""
        cuts = [self.proposed(w.encode().decode("latin-1").translate(self.letters)) for w in new]
        flat = np.array([i for cut in cuts if cut for i in cut], np.int64)
        sizes = np.array([len(cut) if cut else 0 for cut in cuts], np.int64)
        owner = np.repeat(np.arange(len(new)), sizes)
        bad = sizes == 0
        if len(flat) > 1:
            same = owner[1:] == owner[:-1]
            fits = self.compatible((flat[:-1] << 32 | flat[1:])[same])
            bad[owner[1:][same][~fits]] = True
        for i in np.flatnonzero(bad):
            cuts[i] = [self.vocab[t] for t in self.merged(self.symbols(new[i].encode().decode("latin-1").translate(self.letters) + self.suffix))]
        names = self.names
        for word, cut in zip(new, cuts, strict=True):
            self.words[word] = (np.array(cut, "<u4").tobytes(), " ".join([names[i] for i in cut]))

    def encode(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """The ids, as little-endian unsigned 32-bit integers, and the decoded text of each text."""
        usual = [not (UNUSUAL.search(t) or self.added.search(t)) for t in texts]
        cut = [WORDS.findall(t.lower()) if ok else [] for t, ok in zip(texts, usual, strict=True)]
        if len(self.words) > CACHED_WORDS:
            self.words.clear()
        self.learn(list(set().union(*cut).difference(self.words)))
        out = []
        for text, ok, words in zip(texts, usual, cut, strict=True):
            if ok:
                found = [self.words[w] for w in words]
                out.append((b"".join([f[0] for f in found]), " ".join([f[1] for f in found])))
            else:
                ids = self.exact.encode(text, add_special_tokens=False).ids
                out.append((np.array(ids, "<u4").tobytes(), self.exact.decode(ids, skip_special_tokens=False)))
        return out


def loaded(shared) -> WordBpe:
    data = shared.value
    key = hash(data)
    if key not in _LOADED:
        _LOADED[key] = WordBpe(data)
    return _LOADED[key]


def round_trip(docs: DataFrame, tokenizer_json: str, keep: bool = False, id_col="doc_id", text_col="text") -> DataFrame:
    """Encode every text and decode the ids again; with ``keep`` also the ids and the decoded text themselves."""
    shared = broadcast_file(docs.sparkSession, tokenizer_json)
    schema = ENCODED + (", ids array<bigint>, decoded string" if keep else "")

    def step(batch: pa.RecordBatch) -> dict:
        coded, texts, share = [], batch.column(1).to_pylist(), 0
        bpe, part = loaded(shared), []
        for i, text in enumerate(texts):  # so that the new words of a step stay few
            part.append(text)
            share += len(text)
            if share > 4_000_000 or i == len(texts) - 1:
                coded += [(len(a) // 4, sha256(a).hexdigest(), sha256(d.encode()).hexdigest(), *((a, d) if keep else ())) for a, d in bpe.encode(part)]
                part, share = [], 0
        made = {"doc_id": batch.column(0), "n_tokens": pa.array([c[0] for c in coded], pa.int64()),
                "ids_sha256": pa.array([c[1] for c in coded], pa.string()), "decoded_sha256": pa.array([c[2] for c in coded], pa.string())}
        if keep:
            made |= {"ids": pa.array([np.frombuffer(c[3], "<u4").astype("i8") for c in coded], pa.list_(pa.int64())), "decoded": pa.array([c[4] for c in coded], pa.string())}
        return made

    return map_batches(id_and_text(docs, id_col, text_col), step, schema)
