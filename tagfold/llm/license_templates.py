"""License scans by template markup.

A template is a license's wording with regions that may be left out (<<beginOptional>> ... <<endOptional>>) and regions
that may read otherwise (<<var;name=NAME;max=WORDS>>: up to so many words of any kind). Each is compiled into an automaton
over words; a text has the license wherever the automaton accepts, so all mandatory words must stand there, in order and
with nothing between them but what the regions allow. Beside that, fixed phrases are counted wherever they stand.

A place ends with the first run of words that is accepted, and the optional regions that follow it at the template's end.

Defined cases: a null text is empty, has no words and no labels, and scores 0; places may overlap and all count; repeated
rows are each scanned; texts of any length are scanned whole; an empty table gives no rows; other columns, whatever they are
called, play no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tagfold.ship import ship

#: Phrases whose places are counted, with their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: License wordings as published, with markup. Optional regions that open a template are skipped, since a text may lack them.
TEMPLATES = {
    "MIT-notice": "<<beginOptional>>this work is<<endOptional>> released under <<beginOptional>>the terms of<<endOptional>> the MIT License",
    "Apache-2.0-notice": "Licensed under the Apache License<<beginOptional>>,<<endOptional>> Version 2.0",
    "GPL-3.0-notice": "licensed under <<beginOptional>>the terms of<<endOptional>> the GNU General Public License<<beginOptional>>, as published by the Free Software Foundation<<endOptional>><<beginOptional>>,<<endOptional>> <<beginOptional>>either<<endOptional>> version 3",
    "CC-BY-NC-4.0-notice": "Licensed under <<beginOptional>>a Creative Commons license<<endOptional>> CC BY-NC 4.0",
    "rights-reserved-notice": "Copyright <<beginOptional>>(c)<<endOptional>> <<var;name=holder;max=24>> All rights reserved",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of <<var;name=software;max=6>> and associated documentation files
        (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
        distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
        following conditions: The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall be
        included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,
        INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL
        <<var;name=holder;max=24>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
        OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND
        <<var;name=holder;max=24>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE""",
    "BSD": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        <<var;name=bullet;max=1>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        <<var;name=bullet;max=1>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
        in the documentation and/or other materials provided with the distribution. <<beginOptional>><<var;name=bullet;max=1>> Neither the name of
        <<var;name=organization;max=24>> nor the names of its contributors may be used to endorse or promote products derived from this software without
        specific prior written permission.<<endOptional>> THIS SOFTWARE IS PROVIDED BY <<var;name=holder;max=24>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES""",
    "Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
        You may obtain a copy of the License at <<var;name=url;max=24>> Unless required by applicable law or agreed to in writing, software distributed under
        the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""",
    "GPL-header": """<<var;name=program;max=4>> is free software<<beginOptional>>:<<endOptional>> you can redistribute it and/or modify it under the terms of the GNU
        General Public License as published by the Free Software Foundation<<beginOptional>>, either version <<var;name=version;max=2>> of the License<<endOptional>>""",
}

#: Every ASCII byte that isn't a letter or digit becomes a blank, A-Z become a-z; other bytes stay, so words are what [^...]+ finds.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
MARKUP = re.compile(r"<<(beginOptional|endOptional|var)([^>]*)>>")


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split()


@dataclass
class Automaton:
    """States 0, 1, ...; on: what a state does with a word (None: any word) and where it goes; free: moves without a word."""

    lead: bytes = b""
    on: dict[int, tuple[bytes | None, int]] = field(default_factory=dict)
    free: dict[int, list[int]] = field(default_factory=dict)
    end: int = 0
    #: The state behind the last mandatory word.
    tail: int = 0

    def closure(self, states: set[int]) -> set[int]:
        todo, seen = list(states), set(states)
        while todo:
            for s in self.free.get(todo.pop(), ()):
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return seen

    def accepts(self, words: list[bytes], start: int) -> int | None:
        """The end (exclusive) of the shortest accepted run of words from start on with the regions that close it, or None."""
        states, found = self.closure({0}), None
        for i in range(start, len(words) + 1):
            if self.end in states:
                found = i
            if found is not None:  # nothing but what may follow the last mandatory word
                states = {s for s in states if s >= self.tail}
            if i == len(words) or not states:
                break
            states = self.closure({to for s in states if s in self.on for want, to in [self.on[s]] if want is None or want == words[i]})
        return found


def compiled(template: str) -> Automaton:
    """The automaton of a template. Regions before the first mandatory word may be absent from a text, so they are skipped."""
    a, state, opened, lead = Automaton(), 0, [], []
    leading, at = True, 0
    for m in [*MARKUP.finditer(template), None]:
        for w in words_of(template[at : m.start() if m else len(template)]):
            if opened and leading:
                continue
            a.on[state], state = (w, state + 1), state + 1
            if not opened:
                a.tail = state
            if not opened and (leading or lead is not None):
                lead.append(w)
            leading = leading and bool(opened)
        if m is None:
            break
        at = m.end()
        if not leading and lead is not None:
            a.lead, lead = b" " + b" ".join(lead) + b" ", None
        if m[1] == "beginOptional":
            opened.append(state)
        elif m[1] == "endOptional":
            if not leading:
                a.free.setdefault(opened[-1], []).append(state)
            opened.pop()
        elif not leading:
            first, most = state, int(re.search(r"max=(\d+)", m[2])[1])
            for i in range(most):
                a.on[state], state = (None, state + 1), state + 1
            # a state that takes any word may also be left at once for the end of the region
            for s in range(first, state):
                a.free.setdefault(s, []).append(state)
    if lead:
        a.lead = b" " + b" ".join(lead) + b" "
    if opened or a.lead in (b"", b"  "):
        raise ValueError("a template needs a mandatory word and closed regions")
    a.end = state
    return a


def places(canon: bytes, phrase: bytes) -> list[int]:
    """Indices of the words at which phrase (blanks at both ends) stands in canon, which has one blank around each word."""
    out, at, word, last = [], canon.find(phrase), 0, 0
    while at >= 0:
        word += canon.count(b" ", last, at)
        out.append(word)
        last, at = at, canon.find(phrase, at + 1)
    return out


@dataclass
class Scanner:
    phrases: dict[bytes, str]
    automata: dict[str, Automaton]

    def scan(self, text: str | None) -> tuple:
        """n_words, n_base, first_word, last_word, base_labels, labels and score of a text."""
        words = words_of(text or "")
        canon = b" " + b" ".join(words) + b" "
        at, labels, inside = [], set(), []
        for phrase, label in self.phrases.items():
            if found := places(canon, phrase):
                at += found
                labels.add(label)
                n = phrase.count(b" ") - 1
                inside += [(i, i + n) for i in found]
        base = ",".join(sorted(labels))
        for name, a in self.automata.items():
            for i in places(canon, a.lead):
                if (end := a.accepts(words, i)) is not None:
                    labels.add(name)
                    inside.append((i, end))
        covered = last = 0
        for lo, hi in sorted(inside):
            covered += max(0, hi - max(lo, last))
            last = max(last, hi)
        return len(words), len(at), min(at, default=None), max(at, default=None), base, ",".join(sorted(labels)), covered / len(words) if words else 0.0


def scanner(templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None) -> Scanner:
    phrases = PHRASES if phrases is None else phrases
    return Scanner({b" " + b" ".join(words_of(p)) + b" ": label for p, label in phrases.items()}, {k: compiled(t) for k, t in (TEMPLATES if templates is None else templates).items()})


FOUND = [T.StructField("n_words", T.LongType()), T.StructField("n_base", T.LongType()), T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()),
         T.StructField("base_labels", T.StringType()), T.StructField("labels", T.StringType()), T.StructField("score", T.DoubleType())]
ARROW = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]


def scanned(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id and what Scanner.scan() finds, one row per row of docs; score is the share of words inside found places."""
    ship(docs.sparkSession)
    schema, s = T.StructType([docs.schema["doc_id"], *FOUND]), scanner(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [s.scan(x.as_py()) for x in b.column(1)]
            columns = zip(*rows) if rows else [[] for _ in FOUND]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(columns, ARROW))], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)
