"""License scan by template-markup matching.

A template is mandatory wording with marked regions: ``[...]`` is optional,
``{n}`` is replaceable by up to n words, ``(a|b)`` is a choice.  Each template
compiles to an automaton over words.  A place in a text is accepted when the
automaton reaches its end, that is when every mandatory word is there, in
order, with nothing but the marked regions in between.  Base phrases are found
and counted beside the templates.

Null or empty text: no words, no labels, score 0.  Equal rows get equal
results.  Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stacksmith.llm import text as T
from stacksmith.llm.shared import text_col

# Base phrases with their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Label, weight in the score, and template of each notice or license text.
TEMPLATES = [
    ("mit-notice", 0.8, "(released|licensed|distributed|available) under the [terms of the] mit license"),
    ("apache-2.0-notice", 0.8, "licensed under the [terms of the] apache license [version] 2 0"),
    ("gpl-2.0-notice", 0.8, "(licensed|released|distributed) under the [terms of the] gnu general public license [version] 2"),
    ("gpl-3.0-notice", 0.8, "(licensed|released|distributed) under the [terms of the] gnu general public license [version] 3"),
    ("gpl-any-notice", 0.9, "redistribute it and or modify it under the terms of the gnu [(lesser|affero)] general public license as published by "
                            "the free software foundation"),
    ("cc-by-4.0-notice", 0.8, "licensed under [a] [the] (cc|creative commons) (by|attribution) 4 0"),
    ("cc-by-sa-4.0-notice", 0.8, "licensed under [a] [the] (cc|creative commons) (by sa|attribution sharealike) 4 0"),
    ("cc-by-nc-4.0-notice", 0.8, "licensed under [a] [the] (cc|creative commons) (by nc|attribution noncommercial) 4 0"),
    ("mpl-2.0-notice", 0.8, "subject to the terms of the mozilla public license v 2 0"),
    ("mit-text", 0.95, "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
                       "documentation files the software to deal in the software without restriction including without limitation the "
                       "rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
                       "persons to whom the software is furnished to do so subject to the following conditions the above copyright notice "
                       "and this permission notice [including the next paragraph] shall be included in all copies or substantial portions "
                       "of the software the software is provided as is without warranty of any kind"),
    ("isc-text", 0.95, "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted "
                       "provided that the above copyright notice and this permission notice appear in all copies"),
    ("bsd-text", 0.95, "redistribution and use in source and binary forms with or without modification are permitted provided that the "
                       "following conditions are met [1] redistributions of source code must retain the above copyright notice this list of "
                       "conditions and the following disclaimer [2] redistributions in binary form must reproduce the above copyright "
                       "notice this list of conditions and the following disclaimer in the documentation and or other materials provided "
                       "with the distribution [3] [neither the name of {12} nor the names of its contributors may be used to endorse or "
                       "promote products derived from this software without specific prior written permission] this software is provided "
                       "by {8} as is"),
    ("unlicense-text", 0.95, "this is free and unencumbered software released into the public domain anyone is free to copy modify publish "
                             "use compile sell or distribute this software"),
]

_SCHEMA = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, "
           "labels array<string>, score double, matches array<struct<label:string,first:long,last:long>>")


class Automaton:
    """Words to states: ``step[state]`` maps a word (or None for any word) to next states; ``free`` needs no word."""

    def __init__(self, template: str) -> None:
        self.step: list[dict[str | None, set[int]]] = []
        self.free: list[set[int]] = []
        tokens = re.findall(r"[\[\]()|]|\{\d+\}|[^\s\[\]()|{}]+", template.lower())
        start = self._state()
        end, at = self._sequence(tokens, 0, start)
        if at != len(tokens):
            raise ValueError(f"unbalanced template: {template}")
        self.end = end
        self.start = self._close({start})

    def _state(self) -> int:
        self.step.append({})
        self.free.append(set())
        return len(self.step) - 1

    def _sequence(self, tokens: list[str], at: int, state: int) -> tuple[int, int]:
        """Compile up to a closing mark; returns the last state and the mark's position."""
        while at < len(tokens) and tokens[at] not in "])|":
            token = tokens[at]
            if token == "[":
                last, at = self._sequence(tokens, at + 1, state)
                self.free[state].add(last)
                state = last
            elif token == "(":
                join = self._state()
                while tokens[at] != ")":
                    branch = self._state()
                    self.free[state].add(branch)
                    last, at = self._sequence(tokens, at + 1, branch)
                    self.free[last].add(join)
                state = join
            elif token[0] == "{":
                join = self._state()
                for _ in range(int(token[1:-1])):
                    self.free[state].add(join)
                    after = self._state()
                    self.step[state].setdefault(None, set()).add(after)
                    state = after
                self.free[state].add(join)
                state = join
            else:
                after = self._state()
                self.step[state].setdefault(token, set()).add(after)
                state = after
            at += 1
        return state, at

    def _close(self, states: set[int]) -> frozenset[int]:
        todo = list(states)
        while todo:
            for nxt in self.free[todo.pop()] - states:
                states.add(nxt)
                todo.append(nxt)
        return frozenset(states)

    def first_words(self) -> set[str | None]:
        return {w for s in self.start for w in self.step[s]}

    def accept(self, words: list[str], at: int) -> int | None:
        """Index after the longest accepted run of words that starts at ``at``; None if none is."""
        states, found = self.start, None
        while True:
            if self.end in states:
                found = at
            if at >= len(words):
                return found
            word, nxt = words[at], set()
            for s in states:
                nxt |= self.step[s].get(word, set()) | self.step[s].get(None, set())
            if not nxt:
                return found
            states, at = self._close(nxt), at + 1


def longest_literal(template: str) -> str:
    """Longest run of mandatory words: a text without it cannot match."""
    plain = re.sub(r"\{\d+\}", "|", template.lower())
    while True:
        shorter = re.sub(r"\[[^\[\]()]*\]|\([^\[\]()]*\)", "|", plain)
        if shorter == plain:
            return max((" ".join(p.split()) for p in plain.split("|")), key=len)
        plain = shorter


def _scan(phrases: dict[str, str], templates: list[tuple[str, float, str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [(label, weight, f" {longest_literal(t)} ".encode(), Automaton(t)) for label, weight, t in templates]
        base = [(re.compile(b" " + p.encode() + b"(?= )"), label) for p, label in phrases.items()]
        # The cheap test first: every match holds one of these byte strings in its lower-cased text.
        words = {p.split()[-1].encode() for p in phrases} | {max(lit.split(), key=len) for _, _, lit, _ in compiled}
        words = [w for w in words if not any(o != w and o in w for o in words)]
        weights = {label: weight for label, weight, _ in templates}
        for batch in batches:
            out = []
            for lo, hi, buf, offs in T.slices(batch.column(1)):
                starts, _, doc = T.words(buf, offs, T.ALNUM)
                counts = np.bincount(doc, minlength=hi - lo).tolist()
                low = buf.tobytes().translate(T.ALNUM_TABLE)
                hot = set()
                for word in words:
                    at = low.find(word)
                    while at >= 0:
                        hot.add(d := int(np.searchsorted(offs, at, "right")) - 1)
                        at = low.find(word, int(offs[d + 1]))
                for d in range(hi - lo):
                    if d not in hot:
                        out.append((counts[d], 0, None, None, [], [], 0.0, []))
                        continue
                    tokens = low[offs[d]:offs[d + 1]].split()
                    norm = b" " + b" ".join(tokens) + b" "
                    at, labels, matches = [], set(), []
                    for pattern, label in base:
                        if found := [m.start() for m in pattern.finditer(norm)]:
                            at += found
                            labels.add(label)
                    if at:  # blanks before a place: the words before it
                        at = np.searchsorted(np.flatnonzero(np.frombuffer(norm, np.uint8) == 32), at).tolist()
                    method, text = set(), None
                    for label, _, literal, automaton in compiled:
                        if literal not in norm:
                            continue
                        text = text or [t.decode("utf-8", "replace") for t in tokens]
                        begin = automaton.first_words()
                        i = 0
                        while i < len(text):
                            end = automaton.accept(text, i) if text[i] in begin or None in begin else None
                            if end is not None and end > i:
                                matches.append({"label": label, "first": i, "last": end - 1})
                                method.add(label)
                                i = end
                            else:
                                i += 1
                    doubt = 0.5 ** len(labels)
                    for label in method:
                        doubt *= 1 - weights[label]
                    out.append((len(tokens), len(at), min(at, default=None), max(at, default=None), sorted(labels),
                                sorted(labels | method), 1 - doubt, matches))
            cols = list(zip(*out)) if out else [[]] * 8
            strings = pa.list_(pa.string())
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), strings, strings, pa.float64(),
                     pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64())])))
            yield pa.record_batch([batch.column(0), *[pa.array(c, t) for c, t in zip(cols, kinds)]],
                                  names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"])
    return run


def scan_licenses(docs: DataFrame, phrases: dict[str, str] = PHRASES,
                  templates: list[tuple[str, float, str]] = TEMPLATES) -> DataFrame:
    """One row per document: word count, base phrase places, labels, score and the accepted word ranges.

    No shuffle: every row is judged alone.
    """
    return docs.select(F.col("doc_id").cast("long"), text_col().alias("text")).mapInArrow(_scan(phrases, templates), _SCHEMA)
