"""License scan: files are streamed through a generalised suffix automaton of licence tokens.

The automaton holds the words of all templates and phrases. Reading a file word by word gives its matching statistics,
that is at each word the longest run ending there that some template contains. Runs that cannot be extended and are
long enough are chained, template by template, in the order of the file and of the template; a chain that covers
enough of its template labels the file. A phrase is found where the statistics say that all its words end there.

A null text is empty: no words, no labels, score 0. Repeated rows each get their own row; an empty table gives an empty
result; only the id and text columns are read, so other columns can have any name.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchmere.llm.common import scan_rows, table, words_of
from watchmere.llm.suffix_automaton import SuffixAutomaton

# Phrases whose words, standing together, name a licence.
PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}
# Opening passages of public licence notices.
TEMPLATES = {
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
    "associated documentation files, to deal in the Software without restriction, including without limitation the "
    "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
    "permit persons to whom the Software is furnished to do so",
    "apache-text": "you may not use this file except in compliance with the License. You may obtain a copy of the "
    "License at. Unless required by applicable law or agreed to in writing, software distributed under the License is "
    "distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "gpl-text": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
    "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at "
    "your option) any later version",
    "bsd-text": "Redistribution and use in source and binary forms, with or without modification, are permitted "
    "provided that the following conditions are met: Redistributions of source code must retain the above copyright "
    "notice, this list of conditions and the following disclaimer",
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
    "is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
}
LEAST_RUN = 6
MOST_GAP = 12
LEAST_COVER = 0.5
FOUND = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "spans array<struct<label:string,first_word:long,end_word:long,cover:double>>"
)


@dataclass
class Span:
    label: str
    start: int
    end: int
    cover: float


@dataclass
class Chain:
    """Runs of one template, kept in order in file and template."""

    start: int
    end: int
    template_end: int
    covered: int = 0
    runs: list[tuple[int, int]] = field(default_factory=list)


class LicenseScanner:
    def __init__(self, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES):
        self.machine = SuffixAutomaton()
        self.names: list[str] = []
        self.sizes: list[int] = []
        for name, text in templates.items():
            words = words_of(text.encode())
            self.machine.add(len(self.names), words)
            self.names.append(name)
            self.sizes.append(len(words))
        for phrase, label in phrases.items():
            words = words_of(phrase.encode())
            self.machine.add(len(self.names), words)
            self.names.append("")
            self.sizes.append(len(words))
        # A later sequence may split states, so phrases are looked up again once all are in.
        ends: dict[int, list[tuple[int, str]]] = {}
        for phrase, label in phrases.items():
            words = words_of(phrase.encode())
            ends.setdefault(self.machine.statistics(words)[-1][0], []).append((len(words), label))
        self.machine.locate()
        self.phrases: list[tuple[tuple[int, str], ...]] = []
        for state in range(len(self.machine.length)):
            found, at = [], state
            while at > 0:
                found += ends.get(at, [])
                at = self.machine.link[at]
            self.phrases.append(tuple(found))

    def read(self, words: list[bytes]) -> tuple[list[tuple[int, str]], list[tuple[int, int, int]]]:
        """Places of phrases as (first word, label); longest runs as (end word, length, state)."""
        moves, link, length, ends = self.machine.next, self.machine.link, self.machine.length, self.phrases
        first = moves[0]
        places: list[tuple[int, str]] = []
        runs: list[tuple[int, int, int]] = []
        state = matched = 0
        for at, word in enumerate(words):
            if not state:
                state = first.get(word, 0)
                matched = 1 if state else 0
                if not state:
                    continue
            else:
                following = moves[state].get(word)
                if following is None:
                    if matched >= LEAST_RUN:
                        runs.append((at, matched, state))
                    while state and word not in moves[state]:
                        state = link[state]
                    matched = length[state]
                    following = moves[state].get(word, 0)
                    matched = matched + 1 if following else 0
                    state = following
                    if not state:
                        continue
                else:
                    state = following
                    matched += 1
            for size, label in ends[state]:
                if size <= matched:
                    places.append((at + 1 - size, label))
        if matched >= LEAST_RUN:
            runs.append((len(words), matched, state))
        return places, runs

    def chain(self, runs: list[tuple[int, int, int]]) -> list[Span]:
        """Runs in file order join the open chain of their template if they go on in it within the gap."""
        done: list[Span] = []
        open_chains: dict[int, Chain] = {}
        for end, matched, state in runs:
            start = end - matched
            for template, template_end in self.machine.places[state]:
                if not self.names[template]:
                    continue
                chain = open_chains.get(template)
                begin = template_end - matched
                goes_on = (
                    chain is not None
                    and -matched < start - chain.end <= MOST_GAP
                    and -matched < begin - chain.template_end <= MOST_GAP
                )
                if not goes_on:
                    if chain is not None:
                        self._close(template, chain, done)
                    chain = open_chains[template] = Chain(start, start, begin)
                new = min(matched, template_end - max(begin, chain.template_end))
                chain.covered += max(0, new)
                chain.end, chain.template_end = end, max(chain.template_end, template_end)
        for template, chain in open_chains.items():
            self._close(template, chain, done)
        return sorted(done, key=lambda s: (s.start, s.end, s.label))

    def _close(self, template: int, chain: Chain, done: list[Span]) -> None:
        cover = chain.covered / self.sizes[template]
        if cover >= LEAST_COVER:
            done.append(Span(self.names[template], chain.start, chain.end, round(min(1.0, cover), 4)))

    def __call__(self, text: bytes):
        words = words_of(text)
        places, runs = self.read(words)
        spans = self.chain(runs) if runs else []
        base = sorted({label for _, label in places})
        starts = [at for at, _ in places]
        score = 1.0 if places else max((s.cover for s in spans), default=0.0)
        return (
            len(words),
            len(places),
            min(starts, default=None),
            max(starts, default=None),
            ",".join(base),
            ",".join(sorted({*base, *(s.label for s in spans)})),
            score,
            [{"label": s.label, "first_word": s.start, "end_word": s.end, "cover": s.cover} for s in spans],
        )


def scan_licenses(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    phrases: dict[str, str] | None = None,
    templates: dict[str, str] | None = None,
) -> DataFrame:
    """One row per document: phrase places, labels, and the covered template spans in words."""
    chosen = (PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates)
    return scan_rows(documents, [id_col], text_col, FOUND, lambda: LicenseScanner(*chosen))


def op1_license_scan(spark: SparkSession, root: str) -> DataFrame:
    found = scan_licenses(table(spark, root, "documents"))
    written = F.transform("spans", lambda s: F.concat_ws(":", s["label"], s["first_word"], s["end_word"]))
    return found.withColumn("spans", F.concat_ws(",", written))
