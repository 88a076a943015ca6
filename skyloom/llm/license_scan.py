"""License scan by template markup.

A template is the mandatory wording of a license notice with marked regions: ``<<optional>> ... <</optional>>``
may be left out, ``<<any N>>`` stands for up to N words. Each template compiles to an automaton over words. A
place of a text matches when the automaton accepts the words from there on: the mandatory wording must stand
exactly, only marked regions may differ. The longest acceptance from a start counts. Plain phrases are
templates without marks.

Words are runs of ASCII digits and letters and of anything beyond ASCII, after lowering A-Z. Long texts are read in
pieces that overlap by the longest match. A template may start with a marked region; a match starts at its first mandatory or
optional word then, since free words before it say nothing.

Defined results: null and empty texts have no words and no places; equal places of several templates are all
reported; repeated rows are scanned each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Public license texts and notices, with marks.
_MIT = """permission is hereby granted free of charge to any person obtaining a copy of this software <<optional>>and associated documentation files the software<</optional>>
to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software
and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice
<<optional>>including the next paragraph<</optional>> shall be included in all copies or substantial portions of the software
the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose
and noninfringement in no event shall the <<any 12>> be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from
out of or in connection with the software or the use or other dealings in the software"""
_BSD_HEAD = """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
<<optional>>1<</optional>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
<<optional>>2<</optional>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
in the documentation and or other materials provided with the distribution"""
_BSD_NAMES = "<<optional>>3<</optional>> neither the name of <<any 12>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
_BSD_TAIL = """this software is provided by <<any 12>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability
and fitness for a particular purpose are disclaimed in no event shall <<any 12>> be liable for any direct indirect incidental special exemplary or consequential damages
including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability
whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"""
_ISC = """permission to use copy modify and <<optional>>or<</optional>> distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice
and this permission notice appear in all copies the software is provided as is and <<any 6>> disclaims all warranties with regard to this software including all implied warranties
of merchantability and fitness in no event shall <<any 6>> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits
whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"""
_APACHE = """licensed under the apache license version 2 0 the license you may not use <<optional>>this file<</optional>> <<optional>>these files<</optional>> except in compliance with the license
you may obtain a copy of the license at <<any 8>> unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"""
_GPL_VERSION = "either version {} of the license or <<optional>>at your option<</optional>> any later version"
_GPL = """<<any 6>> is free software you can redistribute it and or modify it under the terms of the gnu {} public license as published by the free software foundation
{} {} is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose
see the gnu {} public license for more details"""


def _gpl(name: str, version: str) -> str:
    return _GPL.format(name, _GPL_VERSION.format(version), "<<any 6>>", name)


#: Templates and their labels.
TEMPLATES = {
    "licensed under <<optional>>the<</optional>> apache license <<optional>>version<</optional>> 2 0": "apache-2.0",
    "licensed under the <<optional>>terms of the<</optional>> gnu general public license <<optional>>v3<</optional>> <<optional>>version 3<</optional>>": "gpl-notice",
    "gnu general public license <<any 12>> either version 3 of the license or <<optional>>at your option<</optional>> any later version": "gpl-3.0-or-later",
    "gnu general public license <<any 12>> either version 2 of the license or <<optional>>at your option<</optional>> any later version": "gpl-2.0-or-later",
    "released under the <<optional>>terms of the<</optional>> mit license": "mit-notice",
    "permission is hereby granted free of charge to any person obtaining a copy of this software <<optional>>and associated documentation files the software<</optional>> to deal in the software without restriction": "mit-text",
    "licensed under <<optional>>a creative commons attribution<</optional>> <<optional>>cc by<</optional>> nc <<optional>>sa<</optional>> <<any 1>> 0": "cc-by-nc",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-text",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc-text",
    "copyright <<any 8>> all rights reserved": "all-rights-reserved",
    "<<optional>>this source code form is<</optional>> subject to the terms of the mozilla public license v 2 0": "mpl-2.0",
    "this is free and unencumbered software released into the public domain": "unlicense",
    _MIT: "mit-full",
    f"{_BSD_HEAD} {_BSD_TAIL}": "bsd-2-clause",
    f"{_BSD_HEAD} {_BSD_NAMES} {_BSD_TAIL}": "bsd-3-clause",
    _ISC: "isc-full",
    _APACHE: "apache-2.0-notice",
    _gpl("general", "2"): "gpl-2.0-notice",
    _gpl("general", "3"): "gpl-3.0-notice",
    _gpl("lesser general", "3"): "lgpl-3.0-notice",
    _gpl("affero general", "3"): "agpl-3.0-notice",
}

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_MARK = re.compile(r"<<optional>>|<</optional>>|<<any \d+>>|[^\s<]+")
PIECE = 1 << 20


@dataclass
class Automaton:
    label: str
    base: bool
    #: for each state: word -> next states, next states for any word
    words: list[dict[bytes, frozenset[int]]]
    free: list[frozenset[int]]
    final: int
    must: int
    longest: int

    def accept(self, text: list[bytes], start: int) -> int:
        """End of the longest acceptance from ``start``, or -1."""
        at, end = {0}, -1
        for i in range(start, min(len(text), start + self.longest)):
            w = text[i]
            at = set().union(*(self.words[s].get(w, ()) for s in at), *(self.free[s] for s in at))
            if not at:
                return end
            if self.final in at:
                end = i + 1
        return end


def compile_template(text: str, label: str, base: bool = False) -> Automaton:
    step: list[tuple[int, bytes | None, int]] = []
    skip: list[tuple[int, int]] = []
    state = must = longest = depth = 0
    opened: list[int] = []
    for mark in _MARK.findall(text):
        if mark.startswith("<<any") and not state:
            continue
        if mark == "<<optional>>":
            opened.append(state)
            depth += 1
        elif mark == "<</optional>>":
            skip.append((opened.pop(), state))
            depth -= 1
        elif mark.startswith("<<any"):
            for _ in range(int(mark[6:-2])):
                step.append((state, None, state + 1))
                skip.append((state, state + 1))
                state, longest = state + 1, longest + 1
        else:
            step.append((state, mark.encode(), state + 1))
            state, longest, must = state + 1, longest + 1, must + (not depth)
    onward: dict[int, set[int]] = {s: {s} for s in range(state + 1)}
    for s in range(state, -1, -1):
        for a, b in skip:
            if a == s:
                onward[s] |= onward[b]
    words: list[dict[bytes, frozenset[int]]] = [{} for _ in range(state + 1)]
    free = [frozenset()] * (state + 1)
    for s in range(state + 1):
        for a, w, b in step:
            if a in onward[s]:
                if w is None:
                    free[s] |= onward[b]
                else:
                    words[s][w] = words[s].get(w, frozenset()) | onward[b]
    return Automaton(label, base, words, free, state, must, longest)


def compiled(phrases: dict[str, str], templates: dict[str, str]) -> list[Automaton]:
    return [*(compile_template(t, x, True) for t, x in phrases.items()), *(compile_template(t, x) for t, x in templates.items())]


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, in pieces cut between words."""
    at = 0
    while at < len(text):
        end = at + PIECE
        if end < len(text) and (m := _WORD.match(text, end)):
            end = m.end()
        yield _WORD.findall(text, at, end)
        at = end


def scan(text: str | None, automata: list[Automaton]) -> tuple[int, list[tuple]]:
    """Number of words, and the places: label, base, start, stop, mandatory words."""
    by_first: dict[bytes, list[Automaton]] = {}
    for a in automata:
        for w in a.words[0]:
            by_first.setdefault(w, []).append(a)
    reach = max(a.longest for a in automata)
    found, held, before, pieces = [], [], 0, _pieces((text or "").encode("utf-8", "surrogatepass").translate(_LOWER))
    piece = next(pieces, None)
    while piece is not None:
        held += piece
        piece = next(pieces, None)
        stop = len(held) if piece is None else max(0, len(held) - reach)
        for i in [i for i, w in enumerate(held[:stop]) if w in by_first]:
            for a in by_first[held[i]]:
                if (end := a.accept(held, i)) >= 0:
                    found.append((a.label, a.base, before + i, before + end, a.must))
        before += stop
        held = held[stop:]
    return before, found


def license_places(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """One row per row of ``docs``: id, n_words, places (array of label, base, start, stop, must)."""
    place = pa.struct([("label", pa.string()), ("base", pa.bool_()), ("start", pa.int64()), ("stop", pa.int64()), ("must", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = compiled(phrases, templates)
        names = place.names
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch = whole.slice(k, 256)
                out = [scan(t, automata) for t in batch.column(1).to_pylist()]
                places = pa.array([[dict(zip(names, p, strict=True)) for p in x[1]] for x in out], pa.list_(place))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in out], pa.int64()), places], names=[id_col, "n_words", "places"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_words long, places array<struct<label:string,base:boolean,start:long,stop:long,must:long>>")
