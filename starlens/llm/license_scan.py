"""Licence wording found by token automata compiled from marked-up templates."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Words are runs of ASCII letters and digits and of characters beyond ASCII;
# in UTF-8 the latter are exactly the bytes from 0x80 on.
_TO_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)

#: (label, template): the phrases that every scan looks for.
BASE = (
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
)

# Markup: [[ ]] optional region, {{a|b}} one of these wordings, {{2-5}} that many words of any kind.
TEMPLATES = (
    (
        "mit-text",
        """permission is hereby granted free of charge to any person obtaining a copy of this software and associated
        documentation files the software to deal in the software without restriction including without limitation the
        rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit
        persons to whom the software is furnished to do so subject to the following conditions the above copyright
        notice and this permission notice [[including the next paragraph]] shall be included in all copies or
        substantial portions of the software""",
    ),
    (
        "isc-text",
        """permission to use copy modify and {{or|}} distribute this software for any purpose with or without fee is
        hereby granted provided that the above copyright notice and this permission notice appear in all copies""",
    ),
    (
        "bsd-text",
        """redistribution and use in source and binary forms with or without modification are permitted provided that
        the following conditions are met [[1]] redistributions of source code must retain the above copyright notice
        this list of conditions and the following disclaimer""",
    ),
    (
        "gpl-notice",
        """[[this {{program|work|software|file|library}} is]] {{licensed|released|distributed}} under the
        [[terms of the]] gnu [[{{lesser|affero}}]] general public license [[version {{1-1}} [[or later]]]]""",
    ),
    (
        "gpl-notice",
        """is free software you can redistribute it and or modify it under the terms of the gnu
        [[{{lesser|affero}}]] general public license as published by the free software foundation
        either version {{1-2}} of the license or [[at your option]] any later version""",
    ),
    (
        "apache-notice",
        "[[{{this|the}} {{0-2}} is]] {{licensed|released}} under the [[terms of the]] apache license [[version 2 0]]",
    ),
    ("mit-notice", "{{licensed|released|distributed}} under the [[terms of the]] mit license"),
    (
        "cc-notice",
        """{{licensed|released|available}} under [[{{a|the}}]] {{cc|creative commons}} {{by|attribution}}
        [[{{nc|noncommercial|non commercial}}]] [[{{sa|nd|sharealike|noderivatives}}]] [[{{1-1}} 0]]""",
    ),
    ("cc-by-nc", "{{cc by|creative commons attribution}} {{nc|noncommercial|non commercial}}"),
    ("all-rights-reserved", "[[copyright {{0-6}}]] all rights reserved"),
)


@dataclass
class Automaton:
    """Words lead from state to state; ``skips`` are moves without a word."""

    label: str
    base: bool
    words: list[dict[bytes, list[int]]] = field(default_factory=list)
    any_word: list[list[int]] = field(default_factory=list)
    skips: list[list[int]] = field(default_factory=list)
    accept: int = 0
    needed: tuple[bytes, ...] = ()
    first: dict[bytes, frozenset[int]] = field(default_factory=dict)
    first_any: frozenset[int] = frozenset()

    def state(self) -> int:
        self.words.append({})
        self.any_word.append([])
        self.skips.append([])
        return len(self.words) - 1

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for s in self.skips[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)

    def step(self, states: frozenset[int], word: bytes) -> frozenset[int]:
        found: set[int] = set()
        for s in states:
            found.update(self.words[s].get(word, ()))
            found.update(self.any_word[s])
        return self.closure(found) if found else frozenset()

    def longest(self, words: list[bytes], at: int) -> int:
        """End of the longest accepted run of words from ``at`` on, or -1."""
        states, end = self.closure([0]), -1
        for i in range(at, len(words)):
            states = self.step(states, words[i])
            if not states:
                break
            if self.accept in states:
                end = i + 1
        return end


_MARKS = re.compile(r"\[\[|\]\]|\{\{[^}]*\}\}|[^\s\[\]{}]+")


def compile_template(label: str, template: str, base: bool = False) -> Automaton:
    """Optional regions get a way around, replaceable ones a branch for each wording or for any word."""
    made = Automaton(label, base)
    at = made.state()
    runs, run, opened = [], [], []
    for mark in _MARKS.findall(template):
        if mark == "[[":
            opened.append(at)
        elif mark == "]]":
            if not opened:
                raise ValueError(f"template {label}: ]] without [[")
            end = made.state()
            made.skips[at].append(end)
            made.skips[opened.pop()].append(end)
            at = end
        elif mark.startswith("{{"):
            inside = mark[2:-2]
            end = made.state()
            if span := re.fullmatch(r"(\d+)-(\d+)", inside):
                least, most = int(span[1]), int(span[2])
                for i in range(most + 1):
                    if i >= least:
                        made.skips[at].append(end)
                    if i < most:
                        made.any_word[at].append(nxt := made.state())
                        at = nxt
            else:
                for wording in inside.split("|"):
                    branch = at
                    for word in wording.lower().encode().split():
                        made.words[branch].setdefault(word, []).append(nxt := made.state())
                        branch = nxt
                    made.skips[branch].append(end)
            at = end
        else:
            word = mark.lower().encode()
            made.words[at].setdefault(word, []).append(nxt := made.state())
            at = nxt
            if not opened:
                run.append(word)
                continue
        if run:
            runs.append(b" ".join(run))
            run = []
    if opened:
        raise ValueError(f"template {label}: [[ without ]]")
    if run:
        runs.append(b" ".join(run))
    made.accept = at
    start = made.closure([0])
    if made.accept in start:
        raise ValueError(f"template {label} has no mandatory wording")
    made.needed = tuple(runs)
    made.first_any = frozenset(x for s in start for x in made.any_word[s])
    made.first = {w: frozenset() for s in start for w in made.words[s]}
    return made


@lru_cache(maxsize=8)
def compiled(base: tuple, templates: tuple) -> tuple[Automaton, ...]:
    return tuple(compile_template(n, t, True) for n, t in base) + tuple(compile_template(n, t) for n, t in templates)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TO_WORDS).split()


def find_places(words: list[bytes], automata: tuple[Automaton, ...]) -> list[tuple[Automaton, int, int]]:
    """(automaton, start, end) for every start from which an automaton accepts, longest run each.

    A text without a template's mandatory wording is not walked at all.
    """
    joined = b" %b " % b" ".join(words)
    places = []
    for a in automata:
        if all(b" %b " % run in joined for run in a.needed):
            for i, word in enumerate(words):
                if (word in a.first or a.first_any) and (end := a.longest(words, i)) > 0:
                    places.append((a, i, end))
    return places


RESULT = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, spans array<struct<label:string,first:long,words:long>>"
)


def scan(docs: DataFrame, base: tuple = BASE, templates: tuple = TEMPLATES) -> DataFrame:
    """One row per row of ``docs``: its licence wording.

    ``n_base`` counts all places where the words of a base phrase stand
    consecutively; ``first_word`` and ``last_word`` are their smallest and
    largest start (null without one).  ``labels`` also has the labels of
    templates whose mandatory wording is matched exactly; ``spans`` has every
    place of both kinds.  ``score`` is the share of the text's words that lie
    in any span, 0 for a text without words.  Null text counts as empty, a null
    doc_id stays null, repeated rows come back as often as given, and no other
    column is read.  Each row is scanned by itself, so nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = compiled(base, templates)
        schema = pa.schema([
            ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()),
            ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
            ("spans", pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("words", pa.int64())]))),
        ])
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = words_of(text.as_py())
                places = find_places(words, automata)
                starts = [i for a, i, _ in places if a.base]
                covered = set().union(*(range(i, end) for _, i, end in places)) if places else ()
                rows.append({
                    "doc_id": doc_id,
                    "n_words": len(words),
                    "n_base": len(starts),
                    "first_word": min(starts, default=None),
                    "last_word": max(starts, default=None),
                    "base_labels": ",".join(sorted({a.label for a, _, _ in places if a.base})),
                    "labels": ",".join(sorted({a.label for a, _, _ in places})),
                    "score": len(covered) / len(words) if words else 0.0,
                    "spans": [{"label": a.label, "first": i, "words": end - i} for a, i, end in places],
                })
            yield pa.RecordBatch.from_pylist(rows, schema)

    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"),
    )
    return texts.mapInArrow(run, RESULT)
