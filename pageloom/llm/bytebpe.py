"""Byte-level BPE of a tokenizers JSON file, by the fastest library that gives the same ids."""

from __future__ import annotations

import json
import re

from pageloom.llm.common import UNUSUAL

# The split pattern that byte-level BPE files of this kind imply (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Long runs of one class of characters are left to the library.
LONG_RUN = re.compile(r"\s{200}|[^\s]{2000}")
_LOADED: dict[int, "ByteBpe"] = {}


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte: itself where printable, else the next code point from 256."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteBpe:
    def __init__(self, data: bytes):
        import tiktoken
        from tokenizers import Tokenizer

        spec = json.loads(data)
        bytes_of = byte_alphabet()
        self.exact = Tokenizer.from_buffer(data)
        self.exact.no_truncation()
        self.exact.no_padding()
        added = {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(bytes_of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in added}
        self.fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.size = self.exact.get_vocab_size()

    def encode(self, text: str) -> list[int]:
        if UNUSUAL.search(text) or LONG_RUN.search(text) or self.added and self.added.search(text):
            return self.exact.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def loaded(shared) -> ByteBpe:
    """The tokenizer of a broadcast file, built once in each Python worker."""
    data = shared.value
    key = hash(data)
    if key not in _LOADED:
        _LOADED[key] = ByteBpe(data)
    return _LOADED[key]
