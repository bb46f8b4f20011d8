"""License scans by template-markup matching.

A template is a license text with two kinds of markup: ``<<...>>`` inside ``[[ ]]`` brackets is optional wording, and
``<<name:n>>`` is a replaceable region of up to n words. Each template is compiled once into a token automaton: literal
words, optional branches and bounded gaps. A text is accepted where all mandatory wording follows in order, word for word;
only optional wording may be missing and only replaceable regions may differ.

The scan finds places where the first mandatory words of a template stand (a lookup over word hashes) and runs the
automaton from there; phrases such as "mit license" are found over the same hashes and always counted.

Defined cases: null and empty texts have no words and no places; overlapping places all count; a template word sequence
cut short by the end of a text is not accepted; repeated rows are judged alike.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import table
from .words import Words, find_words, window_hash, with_columns, word_chunks, words_of

# The phrases and labels of the base scan.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Wording of public license notices, with markup. [[...]] optional, <<name:n>> replaceable, up to n words.
TEMPLATES = {
    "mit-notice": "Released under the [[terms of the]] MIT License",
    "apache-2.0-notice": "Licensed under the Apache License [[(the License)]] Version 2.0",
    "gpl-notice": "<<work:6>> licensed under the [[terms of the]] GNU General Public License [[as published by the Free Software "
                  "Foundation]] [[either]] version <<version:1>> [[of the License]] [[or any later version]]",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
                "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
                "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
                "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
                "notice and this permission notice [[(including the next paragraph)]] shall be included in all copies or substantial "
                "portions of the Software. [[THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, "
                "INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.]]",
    "isc-text": "Permission to use, copy, modify, [[and/or]] [[and]] distribute this software for any purpose with or without fee is "
                "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
                "following conditions are met: [[1]] Redistributions of source code must retain the above copyright notice, this list "
                "of conditions and the following disclaimer. [[2]] Redistributions in binary form must reproduce the above copyright "
                "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
                "with the distribution. [[3]] [[Neither the name of <<holder:12>> nor the names of its contributors may be used to "
                "endorse or promote products derived from this software without specific prior written permission.]]",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                         "compliance with the License. You may obtain a copy of the License at <<url:10>> Unless required by applicable "
                         "law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
                  "License as published by the Free Software Foundation, either version <<version:1>> of the License, or [[(at your "
                  "option)]] any later version.",
}

_MARK = re.compile(r"\[\[|\]\]|<<\w+:\d+>>|[^\[\]<>]+")


class Automaton:
    """Token automaton of one template: states are numbers, ``step`` lists (word or None, next state), ``skip`` free moves."""

    def __init__(self, template: str):
        self.words: list[tuple[str | None, int]] = []
        self.skip: dict[int, list[int]] = {}
        open_at: list[int] = []
        literal: list[tuple[int, str]] = []  # mandatory words with their state
        for part in _MARK.findall(template):
            if part == "[[":
                open_at.append(len(self.words))
            elif part == "]]":
                self.skip.setdefault(open_at.pop(), []).append(len(self.words))
            elif part.startswith("<<"):
                for left in range(int(part.strip("<>").split(":")[1]), 0, -1):
                    self.skip.setdefault(len(self.words), []).append(len(self.words) + left)
                    self.words.append((None, len(self.words) + 1))
            else:
                for word in words_of(part):
                    if not open_at:
                        literal.append((len(self.words), word))
                    self.words.append((word, len(self.words) + 1))
        if open_at or not literal:
            raise ValueError("template without mandatory wording or with open brackets")
        self.final = len(self.words)
        self.start = literal[0][0]  # optional and replaceable wording before it accepts the empty text
        self.anchor = [literal[0][1]]
        for (s, _), (t, word) in zip(literal, literal[1:]):
            if t != s + 1 or len(self.anchor) == 4:
                break
            self.anchor.append(word)

    def _closed(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for nxt in self.skip.get(todo.pop(), ()):
                if nxt not in states:
                    states.add(nxt)
                    todo.append(nxt)
        return states

    def match(self, word_at, begin: int, end: int) -> int | None:
        """End of the longest accepted run that starts with word ``begin``, or None."""
        states, best, i = self._closed({self.start}), None, begin
        while True:
            if self.final in states:
                best = i
            if i >= end or not states:
                return best
            word = word_at(i)
            states = self._closed({self.words[s][1] for s in states if s < self.final and self.words[s][0] in (None, word)})
            i += 1


class Scanner:
    """Phrases and templates keyed by the hashes of their first words."""

    def __init__(self, phrases: dict[str, str], templates: dict[str, str]):
        self.phrases = [(self._hash(p.split()), len(p.split()), p.encode(), label) for p, label in phrases.items()]
        self.automata = [(name, a, self._hash(a.anchor), " ".join(a.anchor).encode()) for name, a in ((n, Automaton(t)) for n, t in templates.items())]

    @staticmethod
    def _hash(words: list[str]) -> np.uint64:
        raw = np.frombuffer(" ".join(words).encode(), dtype=np.uint8)
        return window_hash(find_words(raw, np.array([0, len(raw)])).hashes(), len(words))[0]

    def scan(self, w: Words, n_texts: int) -> list[dict]:
        out = [{"n_words": int(w.first[d + 1] - w.first[d]), "places": [], "accepted": []} for d in range(n_texts)]
        hashes, text = w.hashes(), w.text_of()
        windows = {}

        def stands(want, n, phrase):
            if n not in windows:
                windows[n] = window_hash(hashes, n)
            at = np.flatnonzero(windows[n] == want)
            at = at[text[at] == text[at + n - 1]]
            return [i for i in at.tolist() if w.phrase(i, i + n) == phrase]

        for want, n, phrase, label in self.phrases:
            for i in stands(want, n, phrase):
                d = int(text[i])
                out[d]["places"].append({"start": i - int(w.first[d]), "label": label})
        for name, automaton, want, anchor in self.automata:
            for i in stands(want, len(automaton.anchor), anchor):
                d = int(text[i])
                end = automaton.match(lambda j: w.word(j).decode(), i, int(w.first[d + 1]))
                if end is not None:
                    out[d]["accepted"].append({"start": i - int(w.first[d]), "end": end - int(w.first[d]), "label": name})
        return out


RESULT = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("places", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("label", T.StringType())]))),
    T.StructField("accepted", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
                                                        T.StructField("label", T.StringType())])))])


def scan_licenses(docs: DataFrame, *, text: str = "text", phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None) -> DataFrame:
    """``docs`` with n_words, places (phrase starts with labels) and accepted (word spans of accepted templates)."""
    phrases, templates = phrases or PHRASES, templates or TEMPLATES
    made: list[Scanner] = []

    def scan(texts: pa.Array) -> dict:
        if not made:
            made.append(Scanner(phrases, templates))
        rows = [r for lo, hi, w in word_chunks(texts) for r in made[0].scan(w, hi - lo)]
        return {f.name: [r[f.name] for r in rows] for f in RESULT.fields}

    return with_columns(docs, RESULT, scan, text)


def op8_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    starts = F.expr("transform(places, p -> p.start)")
    base = F.expr("array_sort(array_distinct(transform(places, p -> p.label)))")
    every = F.expr("array_sort(array_distinct(concat(transform(places, p -> p.label), transform(accepted, p -> p.label))))")
    score = F.when(F.size("accepted") > 0, 1.0).when(F.size("places") > 0, 0.5).otherwise(0.0)
    return found.select("doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
                        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
                        F.array_join(base, ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), score.alias("score"))
