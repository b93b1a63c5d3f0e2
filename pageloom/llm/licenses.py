"""Licence scan by template markup (operator 8).

A template is licence text with two kinds of markup: ``<<optional>> ... <<end>>`` may be left out, and
``<<any N>>`` stands for up to N words of any kind. All templates are compiled into one automaton over
words, which is made deterministic as texts are read; it is started at every word that can begin a template
and accepts where all mandatory words of one have matched in order. Plain phrases are templates without markup.

Null and empty texts have no words, no places and score 0. Repeated rows, null ids and very long texts get a
row each. No documents: no rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from pageloom.llm.common import id_and_text, map_batches

SCANNED = ("doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, "
           "base_labels string, labels string, score double")
# The phrases that are always looked for, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Public licence texts and notices in template markup.
TEMPLATES = {
    "mit-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of
        <<any 8>> (the <<any 3>>), to deal in the Software without restriction, including without limitation
        the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
        Software, and to permit persons to whom the Software is furnished to do so, subject to the following
        conditions: The above copyright notice and this permission notice <<optional>> (including the next
        paragraph) <<end>> shall be included in all copies or substantial portions of the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
        LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
        IN NO EVENT SHALL <<any 12>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY""",
    "isc-text": """Permission to use, copy, modify, and <<optional>> /or <<end>> distribute this software for any
        purpose with or without fee is hereby granted, provided that the above copyright notice and this
        permission notice appear in all copies.""",
    "bsd-text": """Redistribution and use in source and binary forms, with or without modification, are permitted
        provided that the following conditions are met: <<any 2>> Redistributions of source code must retain
        the above copyright notice, this list of conditions and the following disclaimer. <<any 2>>
        Redistributions in binary form must reproduce the above copyright notice, this list of conditions and
        the following disclaimer in the documentation and/or other materials provided with the distribution.""",
    "apache-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use <<any 6>>
        except in compliance with the License. You may obtain a copy of the License at""",
    "gpl-notice": """This <<any 4>> is free software <<optional>> : you can <<end>> <<optional>> ; you can <<end>>
        redistribute it and/or modify it under the terms of the GNU <<optional>> Lesser <<end>> General Public
        License as published by the Free Software Foundation""",
    "gpl-statement": "licensed under <<optional>> the <<end>> <<optional>> GNU <<end>> General Public License",
    "mit-statement": "licensed under <<optional>> the <<end>> <<optional>> terms of the <<end>> MIT License",
    "apache-statement": "licensed under <<optional>> the <<end>> <<optional>> terms of the <<end>> Apache License",
}
# A phrase alone is worth this much; licence text counts by the share of its mandatory words.
PHRASE_SCORE = 0.5
MOST_STATES = 50_000
# Words hold digits, a to z and everything beyond ASCII; A to Z count as a to z.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(FOLD).split()


class Automaton:
    """Words lead from state to state; state 0 is where every template begins."""

    def __init__(self, templates: dict[str, str]):
        self.ids: dict[bytes, int] = {}
        self.steps: list[dict[int, int]] = [{}]  # by word id; 0 leads on with any word
        self.free: list[list[int]] = [[]]  # ways that need no word
        self.done: list[float] = [0.0]
        self.accepts: list[str | None] = [None]
        for label, markup in templates.items():
            self.add(label, markup)
        self.closures: dict[frozenset, frozenset] = {}
        self.moves: dict[tuple[frozenset, int], frozenset] = {}
        self.start = self.closed(frozenset([0]))
        self.begins = {w for s in self.start for w in self.steps[s]}
        if 0 in self.begins:
            raise ValueError("a template cannot begin with a region of any words")

    def state(self, done: float = 0.0) -> int:
        self.steps.append({})
        self.free.append([])
        self.done.append(done)
        self.accepts.append(None)
        return len(self.steps) - 1

    def add(self, label: str, markup: str) -> None:
        parts: list[tuple[str, object]] = []
        for i, piece in enumerate(markup.replace(">>", "<<").split("<<")):
            kind, _, rest = piece.strip().partition(" ")
            parts += [(kind, rest)] if i % 2 else [("word", w) for w in words_of(piece)]
        mandatory, depth = 0, 0
        for kind, _ in parts:
            depth += (kind == "optional") - (kind == "end")
            mandatory += kind == "word" and depth == 0
        at, seen, opened = self.state(), 0, []
        self.free[0].append(at)
        for kind, value in parts:
            if kind == "word":
                seen += not opened
                after = self.state(seen / mandatory)
                self.steps[at][self.ids.setdefault(value, len(self.ids) + 1)] = after
                at = after
            elif kind == "optional":
                opened.append(at)
            elif kind == "end":
                after = self.state(seen / mandatory)
                self.free[at].append(after)
                self.free[opened.pop()].append(after)
                at = after
            else:  # any N
                last = self.state(seen / mandatory)
                for _ in range(int(value)):
                    self.free[at].append(last)
                    after = self.state(seen / mandatory)
                    self.steps[at][0] = after
                    at = after
                self.free[at].append(last)
                at = last
        self.accepts[at] = label

    def closed(self, states: frozenset) -> frozenset:
        found = self.closures.get(states)
        if found is None:
            todo, seen = list(states), set(states)
            while todo:
                for s in self.free[todo.pop()]:
                    if s not in seen:
                        seen.add(s)
                        todo.append(s)
            found = self.closures[states] = frozenset(seen)
        return found

    def moved(self, states: frozenset, word: int) -> frozenset:
        key = (states, word)
        found = self.moves.get(key)
        if found is None:
            if len(self.moves) > MOST_STATES:
                self.moves.clear()
                self.closures.clear()
            steps = [self.steps[s] for s in states]
            to = {s[word] for s in steps if word and word in s} | {s[0] for s in steps if 0 in s}
            found = self.moves[key] = self.closed(frozenset(to))
        return found

    def places(self, words: list[bytes]) -> tuple[list[tuple[str, int]], float]:
        """(label, start) of every template found, and the largest share of one that matched."""
        get, begins, out, best = self.ids.get, self.begins, [], 0.0
        ids = [get(w, 0) for w in words]
        for start, word in enumerate(ids):
            if word in begins:
                states, at, labels = self.start, start, set()
                while states and at < len(ids):
                    states = self.moved(states, ids[at])
                    at += 1
                    for s in states:
                        if self.done[s] > best:
                            best = self.done[s]
                        if self.accepts[s]:
                            labels.add(self.accepts[s])
                out += [(label, start) for label in labels]
        return out, best


_LOADED: dict[str, Automaton] = {}


def loaded(templates: dict[str, str]) -> Automaton:
    key = repr(templates)
    if key not in _LOADED:
        _LOADED[key] = Automaton(templates)
    return _LOADED[key]


def scan(docs: DataFrame, phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None,
         keep_places: bool = False, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per document; with ``keep_places`` also every (label, word) found."""
    phrases = PHRASES if phrases is None else phrases
    templates = TEMPLATES if templates is None else templates
    schema = SCANNED + (", places array<struct<label:string,word:bigint>>" if keep_places else "")

    def step(batch: pa.RecordBatch) -> dict:
        plain, marked = loaded({p: p for p in phrases}), loaded(templates)
        out = {name.split()[0]: [] for name in SCANNED.split(", ")} | {"places": []}
        for text in batch.column(1).to_pylist():
            words = words_of(text)
            # Phrases are keys here: a phrase accepts under its own words, then gets its label.
            named, _ = plain.places(words)
            found, best = marked.places(words)
            named = [(phrases[p], at) for p, at in named]
            base = {label for label, _ in named}
            starts = [at for _, at in named]
            out["n_words"].append(len(words))
            out["n_base"].append(len(named))
            out["first_word"].append(min(starts, default=None))
            out["last_word"].append(max(starts, default=None))
            out["base_labels"].append(",".join(sorted(base)))
            out["labels"].append(",".join(sorted(base | {label for label, _ in found})))
            out["score"].append(float(max(best, PHRASE_SCORE if named else 0.0)))
            out["places"].append([{"label": label, "word": at} for label, at in sorted(named + found, key=lambda x: (x[1], x[0]))])
        out["doc_id"] = batch.column(0)
        types = {"score": pa.float64(), "base_labels": pa.string(), "labels": pa.string(),
                 "places": pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))}
        return {k: v if k == "doc_id" else pa.array(v, types.get(k, pa.int64())) for k, v in out.items()}

    return map_batches(id_and_text(docs, id_col, text_col), step, schema)
