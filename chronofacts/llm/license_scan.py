"""License scans: template-markup matching with token automata.

A template is license wording with markup in the style of the public SPDX matching guidelines:
``<<optional>> ... <<end>>`` may be absent, ``<<replace:a-b>>`` stands for a to b words of any kind.
Each template is compiled to a nondeterministic automaton over words. A text is accepted where all
mandatory wording stands consecutively, but for those regions. The base phrases are templates without markup.

Nulls and empty texts have no words and no labels. Repeated rows are judged row by row.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_column, fresh_name, words

#: Phrases and their labels. Fixed values.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Wording of public licenses, shortened to the sentences that tell them apart. Fixed values.
TEMPLATES = {
    "mit": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files <<optional>> the software <<end>> to deal in the software without restriction",
        "licensed under the mit <<optional>> open source <<end>> license",
        "released under <<optional>> the terms of <<end>> the mit license",
    ],
    "apache-2": [
        "licensed under the apache license version 2 <<optional>> 0 <<end>> the license you may not use this file except in compliance with the license",
        "apache license <<optional>> version <<end>> 2 0",
    ],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "under the <<optional>> terms of the <<end>> <<replace:0-2>> bsd <<optional>> style <<end>> license",
    ],
    "gpl": [
        "under the terms of the gnu general public license as published by the free software foundation <<optional>> either version <<replace:1-2>> of the license <<end>>",
        "gnu general public license <<optional>> version <<end>> <<replace:1-2>> or later",
    ],
    "lgpl": ["under the terms of the gnu lesser general public license"],
    "mpl-2": ["subject to the terms of the mozilla public license <<optional>> v <<end>> <<optional>> version <<end>> 2 0"],
    "cc-by-nc": ["creative commons attribution noncommercial <<optional>> sharealike <<end>> <<optional>> <<replace:1-2>> international <<end>> <<optional>> public <<end>> license"],
    "cc-by": ["licensed under <<optional>> a <<end>> <<optional>> the <<end>> creative commons attribution <<optional>> <<replace:1-2>> international <<end>> license"],
    "all-rights-reserved": ["copyright <<optional>> c <<end>> <<replace:1-6>> all rights reserved"],
}


@dataclass
class Automaton:
    """Word transitions, any-word transitions and jumps between states; state 0 starts, ``last`` accepts."""

    label: str
    base: bool = False
    edges: list[tuple[int, bytes, int]] = field(default_factory=list)
    any_edges: list[tuple[int, int]] = field(default_factory=list)
    jumps: list[tuple[int, int]] = field(default_factory=list)
    last: int = 0

    def _state(self) -> int:
        self.last += 1
        return self.last

    def close(self) -> Automaton:
        """Each state's word moves and any-word moves after all jumps; what can start a match."""
        ahead = {s: {s} for s in range(self.last + 1)}
        for s in reversed(range(self.last + 1)):
            for a, b in self.jumps:
                if a == s:
                    ahead[s] |= ahead[b]
        self.moves = [{} for _ in range(self.last + 1)]
        self.wild = [set() for _ in range(self.last + 1)]
        for s, near in ahead.items():
            for a, word, b in self.edges:
                if a in near:
                    self.moves[s].setdefault(word, set()).add(b)
            for a, b in self.any_edges:
                if a in near:
                    self.wild[s].add(b)
        self.accepting = {s for s, near in ahead.items() if self.last in near}
        self.first = set(self.moves[0])
        return self

    def match(self, text: list[bytes], start: int) -> int:
        """Where the longest match from ``start`` ends, or -1."""
        now, at, end = {0}, start, -1
        while now:
            if now & self.accepting:
                end = at
            if at == len(text):
                break
            word = text[at]
            now = {b for s in now for b in (*self.moves[s].get(word, ()), *self.wild[s])}
            at += 1
        return end


def compile_template(label: str, markup: str, base: bool = False) -> Automaton:
    """Markup to automaton. A template must start with a mandatory word; regions nest."""
    out, at, open_at = Automaton(label, base), 0, []
    for token in re.findall(r"<<[^>]*>>|[^\s<]+", markup):
        if token == "<<optional>>":
            open_at.append(at)
        elif token == "<<end>>":
            begin, after = open_at.pop(), out._state()
            out.jumps += [(at, after), (begin, after)]
            at = after
        elif m := re.fullmatch(r"<<replace:(\d+)-(\d+)>>", token):
            low, high = int(m[1]), int(m[2])
            for k in range(high):
                begin, at = at, out._state()
                out.any_edges.append((begin, at))
                if k >= low:
                    out.jumps.append((begin, at))
        elif token.startswith("<<"):
            raise ValueError(f"unknown markup {token}")
        else:
            for word in words(token.encode()):
                begin, at = at, out._state()
                out.edges.append((begin, word, at))
    if open_at:
        raise ValueError("an optional region is not closed")
    out.last = at
    out.close()
    if out.wild[0] or 0 in out.accepting or len(out.first) != 1:
        raise ValueError("a template starts with a mandatory word")
    return out


class Scanner:
    def __init__(self, base: dict[str, str], templates: dict[str, list[str]]) -> None:
        self.automata = [compile_template(label, phrase, True) for phrase, label in base.items()] + [compile_template(label, t) for label, all_of in templates.items() for t in all_of]
        self.by_first: dict[bytes, list[Automaton]] = {}
        for a in self.automata:
            self.by_first.setdefault(next(iter(a.first)), []).append(a)

    def scan(self, text: list[bytes]) -> dict:
        present = self.by_first.keys() & set(text)
        places, base, labels, covered = [], set(), set(), set()
        for word in present:
            at = -1
            for _ in range(text.count(word)):
                at = text.index(word, at + 1)
                for a in self.by_first[word]:
                    end = a.match(text, at)
                    if end >= 0:
                        labels.add(a.label)
                        covered.update(range(at, end))
                        if a.base:
                            base.add(a.label)
                            places.append(at)
        n = len(text)
        return {
            "n_words": n, "n_base": len(places), "first_word": min(places, default=None), "last_word": max(places, default=None),
            "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(labels | base)), "score": len(covered) / n if n else 0.0,
        }


_FOUND = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_base", T.LongType()), T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()),
    T.StructField("base_labels", T.StringType()), T.StructField("labels", T.StringType()), T.StructField("score", T.DoubleType()),
])


def scan_licenses(docs: DataFrame, text: str = "text", base: dict[str, str] = BASE, templates: dict[str, list[str]] = TEMPLATES) -> tuple[DataFrame, str]:
    """``docs`` with one struct column more, and its name. ``score`` is the share of words that matches cover. No shuffle."""
    name = fresh_name(docs, "licenses")

    def make():
        scanner = Scanner(base, templates)
        return lambda texts: [scanner.scan(words(x)) for x in texts]

    return add_column(docs, name, _FOUND, text, make), name


def license_report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id and the scan's columns."""
    found, c = scan_licenses(docs.select("doc_id", "text"))
    return found.select("doc_id", *(F.col(c)[f.name].alias(f.name) for f in _FOUND.fields))
