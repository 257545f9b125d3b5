"""License scans with template markup compiled into token automata.

A template is plain wording with ``<<beginOptional>> ... <<endOptional>>``
around what may be missing and ``<<var;max=N>>`` for up to N words that may be
anything.  It compiles to an automaton over words: an edge per mandatory word,
empty edges around optional regions, and loops of bounded length for replaceable
ones.  A text gets the template's label if its words hold a run that the
automaton accepts, that is, one with exactly the mandatory wording.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contextlake.llm import textbuf

GAP = np.ones(256, dtype=bool)
GAP[0x30:0x3A] = GAP[0x61:0x7B] = GAP[0x80:] = False
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: Fixed phrases and their labels.
BASE = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}

#: Fixed wordings of common notices.
TEMPLATES = {
    "mit": "released under the MIT License",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files <<beginOptional>> the software <<endOptional>> to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice <<beginOptional>> including the next paragraph <<endOptional>> shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the <<var;max=6>> be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files <<beginOptional>> the software <<endOptional>> to deal in the software without restriction",
    "apache": "licensed under the Apache License <<beginOptional>> version 2 0 <<endOptional>>",
    "gpl": "licensed under the <<beginOptional>> terms of the <<endOptional>> GNU <<beginOptional>> lesser <<endOptional>> <<beginOptional>> affero <<endOptional>> General Public License <<beginOptional>> version <<var;max=1>> <<endOptional>>",
    "gpl-text": "you can redistribute it and or modify it under the terms of the GNU <<beginOptional>> lesser <<endOptional>> General Public License as published by the Free Software Foundation",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted <<beginOptional>> provided that the following conditions are met <<endOptional>>",
    "bsd-text": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met <<beginOptional>> 1 <<endOptional>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer <<beginOptional>> 2 <<endOptional>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution <<beginOptional>> <<beginOptional>> 3 <<endOptional>> neither the name of <<var;max=12>> nor the names of <<var;max=3>> contributors may be used to endorse or promote products derived from this software without specific prior written permission <<endOptional>> this software is provided by <<var;max=8>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall <<var;max=8>> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    "apache-text": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    "bsd-notice": "licensed under the <<beginOptional>> <<var;max=2>> clause <<endOptional>> BSD <<beginOptional>> <<var;max=2>> clause <<endOptional>> license",
    "mpl": "subject to the terms of the Mozilla Public License <<beginOptional>> v <<var;max=2>> <<endOptional>>",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "isc-text": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and <<var;max=4>> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall <<var;max=4>> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "cc-by": "licensed under <<beginOptional>> a <<endOptional>> <<beginOptional>> the <<endOptional>> Creative Commons Attribution <<var;max=4>> license",
    "cc": "licensed under CC BY <<beginOptional>> NC <<endOptional>> <<beginOptional>> SA <<endOptional>> <<beginOptional>> ND <<endOptional>> <<var;max=2>>",
    "cc0": "CC0 <<beginOptional>> 1 0 <<endOptional>> universal",
    "proprietary": "all rights reserved",
}

ANY = b""


@dataclass(frozen=True)
class Automaton:
    """``edges[s]``: (word or ANY, next state, mandatory); ``empty[s]``: states
    reached without a word; state 0 starts and the last one accepts."""

    label: str
    edges: tuple[tuple[tuple[bytes, int, bool], ...], ...]
    empty: tuple[tuple[int, ...], ...]
    mandatory: int

    def closure(self, states: dict[int, int]) -> dict[int, int]:
        """States reached by empty edges, each with the most mandatory words seen."""
        todo = list(states)
        while todo:
            s = todo.pop()
            for t in self.empty[s]:
                if states.get(t, -1) < states[s]:
                    states[t] = states[s]
                    todo.append(t)
        return states

    def starts(self) -> set[bytes]:
        """Words that a run can start with; ``ANY`` if it can start with any."""
        return {w for s in self.closure({0: 0}) for w, _, _ in self.edges[s]}

    def run(self, words: list[bytes], at: int) -> tuple[bool, int]:
        """(accepted, most mandatory words matched) of a run starting at ``at``."""
        states, best, last = self.closure({0: 0}), 0, len(self.edges) - 1
        for word in words[at:]:
            after: dict[int, int] = {}
            for s, seen in states.items():
                for w, t, counts in self.edges[s]:
                    if w == word or w == ANY:
                        after[t] = max(after.get(t, -1), seen + counts)
            if not after:
                break
            states = self.closure(after)
            best = max(best, *states.values())
            if last in states:
                return True, self.mandatory
        return False, best


def compile_template(label: str, markup: str) -> Automaton:
    edges: list[list[tuple[bytes, int, bool]]] = [[]]
    empty: list[list[int]] = [[]]
    opened: list[int] = []
    mandatory = 0

    def add() -> int:
        edges.append([])
        empty.append([])
        return len(edges) - 1

    for mark, wording in re.findall(r"<<([^>]*)>>|([^<]+)", markup):
        if mark == "beginOptional":
            opened.append(len(edges) - 1)
        elif mark == "endOptional":
            here = len(edges) - 1
            end = add()
            empty[here].append(end)
            empty[opened.pop()].append(end)
        elif mark:
            first, most = len(edges) - 1, int(dict(p.split("=") for p in mark.split(";")[1:]).get("max", 8))
            steps = [first]
            for _ in range(most):
                steps.append(add())
                edges[steps[-2]].append((ANY, steps[-1], False))
            end = add()
            for s in steps:
                empty[s].append(end)
        else:
            for word in WORD.findall(textbuf.lower(np.frombuffer(wording.encode(), np.uint8)).tobytes()):
                s = len(edges) - 1
                edges[s].append((word, add(), not opened))
                mandatory += not opened
    if opened:
        raise ValueError(f"{label}: an optional region is not closed")
    return Automaton(label, tuple(map(tuple, edges)), tuple(map(tuple, empty)), mandatory)


def scan(words: list[bytes], automata: list[tuple[Automaton, set[bytes]]]) -> tuple[set[str], float]:
    """(labels accepted, best share of a template's mandatory words, 1 if accepted)."""
    labels: set[str] = set()
    score = 0.0
    for automaton, starts in automata:
        for at, word in enumerate(words):
            if word in starts or ANY in starts:
                accepted, best = automaton.run(words, at)
                score = max(score, 1.0 if accepted else best / (automaton.mandatory + 1))
                if accepted:
                    labels.add(automaton.label)
                    break
    return labels, score


def _scanned(batches: Iterable[pa.RecordBatch], templates: dict[str, str]) -> Iterator[pa.RecordBatch]:
    compiled = [compile_template(k, v) for k, v in templates.items()]
    automata = [(a, a.starts()) for a in compiled]
    # the words that a run can start with: no other text has a score or needs a look word by word
    anchors = {w for _, starts in automata for w in starts} | {b"license"}
    trigger = re.compile(b"|".join(re.escape(w) for w in sorted(anchors)))
    base = {tuple(w.encode() for w in phrase): label for phrase, label in BASE.items()}
    for batch in batches:
        for i, j, data, offsets in textbuf.blocks(batch.column(1)):
            data = textbuf.lower(data)
            starts, _, row = textbuf.words(data, offsets, GAP)
            n = j - i
            out = {"n_words": np.bincount(row, minlength=n).tolist(), "n_base": [0] * n, "first_word": [None] * n, "last_word": [None] * n, "base_labels": [""] * n, "labels": [""] * n, "score": [0.0] * n}
            whole = data.tobytes()
            for r in range(n):
                if not trigger.search(whole, offsets[r], offsets[r + 1]):
                    continue
                words = WORD.findall(whole, offsets[r], offsets[r + 1])
                places = sorted((p, label) for phrase, label in base.items() for p in range(len(words) - len(phrase) + 1) if words[p + len(phrase) - 1] == phrase[-1] and tuple(words[p : p + len(phrase)]) == phrase)
                found, score = scan(words, automata)
                own = {label for _, label in places}
                if places:
                    out["first_word"][r], out["last_word"][r] = places[0][0], places[-1][0]
                out["n_base"][r], out["score"][r] = len(places), score
                out["base_labels"][r], out["labels"][r] = ",".join(sorted(own)), ",".join(sorted(own | found))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, n), *[pa.array(v, t) for v, t in zip(out.values(), types, strict=True)]], ["id", *out])


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score).

    ``score``: the largest share, over templates and places, of a template's
    mandatory words that a run matched before it ended, of one more than these;
    1 if a template is accepted.  A template without mandatory words is accepted
    where any of its words stand; one without words never.

    A null text is empty: 0 words, no labels, score 0.  Labels are distinct,
    sorted and comma-joined.  Every row gives a row, whatever its id, and repeated
    rows give equal rows; other columns are ignored; an empty table gives an empty one.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = "id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return texts.mapInArrow(partial(_scanned, templates=templates or TEMPLATES), schema).withColumnRenamed("id", id_col)
