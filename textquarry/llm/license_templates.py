"""License scans by template markup: wording that must stand, regions that may be left out, regions that may be replaced.

Markup of a template, over words (letters and digits; case and punctuation never count):

* ``word``: mandatory, must stand exactly;
* ``[[ … ]]``: an optional region, may hold any markup;
* ``{{one way|another way}}``: a replaceable region with the wordings it may have;
* ``{{*n}}``: a replaceable region of any 0 to n words.

Templates compile to one token automaton. Its states are the places in the templates; sets of places are made to states of a
deterministic automaton when a text first meets them. It starts at every word that can begin a template and runs while a template can
still be met, so a text is read once and a start costs at most the length of the longest template. A template is accepted where all
its mandatory wording has been read in order; per start and label the longest accepted span counts.

Each text is scanned where it is read; nothing is shuffled. The base phrases are templates without regions.

Nulls: a null text is empty; null ids stay. An empty text has no words and no label. Repeated rows are scanned each on its own. Very
long texts are scanned whole, a row at a time. Ties: spans of several labels may begin at one word, all of them count. Columns other
than the id and the text are not read, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.llm.common import map_batches

# Phrases that every license scan reports, and their labels.
BASE_PHRASES = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))

# Public wordings of licenses and of the notices that name them, with their markup.
TEMPLATES = (
    ("mit", "{{released|licensed|distributed|available}} under [[the]] [[terms of the]] mit license"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"
        " [[the software]] to deal in the software without restriction including without limitation the rights to use copy modify merge"
        " publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so"
        " subject to the following conditions [[the above copyright notice and this permission notice [[including the next paragraph]]"
        " shall be included in all copies or substantial portions of the software]]",
    ),
    (
        "isc",
        "permission to use copy modify and {{or|}} distribute this software for any purpose with or without fee is hereby granted"
        " provided that the above copyright notice and this permission notice appear in all copies",
    ),
    (
        "bsd-3-clause",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following"
        " conditions are met [[1]] redistributions of source code must retain the above copyright notice this list of conditions and the"
        " following disclaimer [[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and"
        " the following disclaimer in the documentation and or other materials provided with the distribution [[3]] neither the name of"
        " {{*20}} nor the names of its contributors may be used to endorse or promote products derived from this software without"
        " specific prior written permission",
    ),
    ("apache-2.0", "licensed under the apache license [[version]] 2 0 [[the license {{*12}} you may not use this file except in compliance with the license]]"),
    ("gpl-2.0", "{{licensed|released|distributed}} under [[the terms of]] [[the]] gnu general public license [[{{version|v}}]] 2 [[0]]"),
    ("gpl-3.0", "{{licensed|released|distributed}} under [[the terms of]] [[the]] gnu general public license [[{{version|v}}]] 3 [[0]]"),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"
        " as published by the free software foundation either version {{2|3}} of the license or at your option any later version",
    ),
    ("cc-by-4.0", "licensed under [[a]] {{cc|creative commons}} {{by|attribution}} 4 0"),
    ("cc-by-sa-4.0", "licensed under [[a]] {{cc|creative commons}} {{by sa|attribution sharealike}} 4 0"),
    ("cc-by-nc-4.0", "licensed under [[a]] {{cc|creative commons}} {{by nc|attribution noncommercial}} 4 0"),
)

# Score of a text: an accepted template, a base phrase alone, neither.
ACCEPTED, NAMED, NOTHING = 1.0, 0.5, 0.0


# --- words --------------------------------------------------------------------------------------------------------

_SPACE_OR_LOWER = bytes(b if b > 127 or chr(b).isalnum() and not chr(b).isupper() else b + 32 if chr(b).isupper() else 32 for b in range(256))


def word_list(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text: ASCII letters and digits and everything beyond ASCII; A-Z lower-cased, all other characters as they are."""
    return text.translate(_SPACE_OR_LOWER).split()


# --- markup -------------------------------------------------------------------------------------------------------

_MARK = re.compile(r"\[\[|\]\]|\{\{\*(\d+)\}\}|\{\{([^{}]*)\}\}|([^\s\[\]{}]+)")


def parse(markup: str) -> list:
    """The markup as a list of ``("word", w)``, ``("any", n)``, ``("one", [[words], …])`` and ``("maybe", [nodes])``."""
    stack: list[list] = [[]]
    at = 0
    for m in _MARK.finditer(markup):
        if markup[at : m.start()].strip():
            raise ValueError(f"markup is not balanced near {markup[at : m.start()]!r}")
        at = m.end()
        if m[0] == "[[":
            stack.append([])
        elif m[0] == "]]":
            if len(stack) == 1:
                raise ValueError("an optional region ends that never began")
            inner = stack.pop()
            stack[-1].append(("maybe", inner))
        elif m[1] is not None:
            stack[-1].append(("any", int(m[1])))
        elif m[2] is not None:
            stack[-1].append(("one", [w.split() for w in m[2].split("|")]))
        else:
            stack[-1].append(("word", m[3]))
    if len(stack) > 1 or markup[at:].strip():
        raise ValueError("an optional region does not end")
    return stack[0]


# --- the automaton ------------------------------------------------------------------------------------------------


@dataclass
class Automaton:
    """Places of all templates. ``steps[p]``: (word, place) pairs, the word None for any; ``free[p]``: places reached without a word."""

    steps: list[list[tuple[bytes | None, int]]] = field(default_factory=list)
    free: list[list[int]] = field(default_factory=list)
    accepts: dict[int, int] = field(default_factory=dict)

    def place(self) -> int:
        self.steps.append([])
        self.free.append([])
        return len(self.steps) - 1

    def add(self, nodes: list, start: int) -> int:
        """Append the nodes behind ``start``; the place behind them."""
        for kind, value in nodes:
            if kind == "word":
                start = self._words([value], start)
            elif kind == "any":
                behind = self.place()
                for _ in range(value):
                    self.free[start].append(behind)
                    following = self.place()
                    self.steps[start].append((None, following))
                    start = following
                self.free[start].append(behind)
                start = behind
            elif kind == "one":
                behind = self.place()
                for way in value:
                    self.free[self._words(way, start)].append(behind)
                start = behind
            else:
                behind = self.place()
                self.free[start].append(behind)
                self.free[self.add(value, start)].append(behind)
                start = behind
        return start

    def _words(self, ws: list[str], start: int) -> int:
        here = self.place()
        self.free[start].append(here)
        for w in ws:
            following = self.place()
            self.steps[here].append((w.encode(), following))
            here = following
        return here

    def closure(self, places) -> frozenset[int]:
        todo, seen = list(places), set(places)
        while todo:
            for p in self.free[todo.pop()]:
                if p not in seen:
                    seen.add(p)
                    todo.append(p)
        return frozenset(seen)


class Matcher:
    """The templates as a deterministic automaton over words, its states made when first met."""

    def __init__(self, templates: tuple[tuple[str, str], ...]):
        self.labels = [label for label, _ in templates]
        net = Automaton()
        first = net.place()
        for k, (_, markup) in enumerate(templates):
            begin = net.place()
            net.free[first].append(begin)
            net.accepts[net.add(parse(markup), begin)] = k
        self.net = net
        self.numbers: dict[frozenset[int], int] = {}
        self.states: list[frozenset[int]] = []
        self.known: list[dict[bytes, int]] = []
        self.accepted: list[tuple[int, ...]] = []
        self.start = self._state(net.closure([first]))
        opening = [w for p in self.states[self.start] for w, _ in net.steps[p]]
        if None in opening or self.accepted[self.start]:
            raise ValueError("a template has to begin with a word")
        self.opening = frozenset(opening)

    def _state(self, places: frozenset[int]) -> int:
        if places not in self.numbers:
            self.numbers[places] = len(self.states)
            self.states.append(places)
            known = {w for p in places for w, _ in self.net.steps[p] if w is not None}
            self.known.append(dict.fromkeys(known, -2))  # -2: not made yet
            self.known[-1][b""] = -2  # any other word
            self.accepted.append(tuple(sorted(self.net.accepts[p] for p in places if p in self.net.accepts)))
        return self.numbers[places]

    def _step(self, state: int, word: bytes) -> int:
        """The state behind a word, -1 if there is none. The empty word stands for all that the state's places do not name."""
        known = self.known[state]
        word = word if word in known else b""
        if known[word] == -2:
            to = [q for p in self.states[state] for w, q in self.net.steps[p] if w is None or w == word]
            known[word] = self._state(self.net.closure(to)) if to else -1
        return known[word]

    def spans(self, words: list[bytes]) -> list[tuple[int, int, str]]:
        """``(start, end, label)`` of every accepted template, the longest per start and label; by start, then label."""
        out = []
        opening = self.opening
        for begin in [i for i, w in enumerate(words) if w in opening]:
            state, at, found = self.start, begin, {}
            while at < len(words) and (state := self._step(state, words[at])) >= 0:
                at += 1
                for k in self.accepted[state]:
                    found[self.labels[k]] = at
            out += [(begin, end, label) for label, end in sorted(found.items())]
        return out


# --- documents ----------------------------------------------------------------------------------------------------

_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string())])
FOUND = "doc_id long, n_words long, base array<struct<start: long, end: long, label: string>>, spans array<struct<start: long, end: long, label: string>>"


def find_licenses(
    docs: DataFrame,
    templates: tuple[tuple[str, str], ...] = TEMPLATES,
    base: tuple[tuple[str, str], ...] = BASE_PHRASES,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``doc_id, n_words, base, spans`` of every document: places of the base phrases, and of accepted templates, as word numbers."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases, licenses = Matcher(base), Matcher(templates)
        for batch in batches:
            counts, places, accepted = [], [], []
            for value in batch.column(1):
                words = word_list(value.as_buffer().to_pybytes() if value.is_valid else b"")
                counts.append(len(words))
                for out, matcher in ((places, phrases), (accepted, licenses)):
                    out.append([{"start": s, "end": e, "label": n} for s, e, n in matcher.spans(words)])
            made = [batch.column(0), pa.array(counts, pa.int64()), pa.array(places, pa.list_(_SPAN)), pa.array(accepted, pa.list_(_SPAN))]
            yield pa.RecordBatch.from_arrays(made, ["doc_id", "n_words", "base", "spans"])

    return map_batches(docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")), work, FOUND)


def report(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """One row per document: counts and ends of the base places, the labels, and a score (1 template accepted, 0.5 base phrase only)."""
    labels = lambda *spans: F.array_join(F.array_sort(F.array_distinct(F.concat(*[F.transform(s, lambda x: x["label"]) for s in spans]))), ",")
    starts = F.transform("base", lambda x: x["start"])
    score = F.when(F.size("spans") > 0, ACCEPTED).when(F.size("base") > 0, NAMED).otherwise(NOTHING)
    return find_licenses(docs, templates).select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels("base").alias("base_labels"), labels("base", "spans").alias("labels"), score.alias("score"),
    )
