"""License scan: fixed phrases, and template-markup matching with token automata.

Templates hold plain wording with markup: ``<<opt ...>>`` may be left out, ``<<any N>>`` stands for up to N replaceable
words, and after ``<<not ...>>`` at the end none of its words may follow. A template compiles into a token automaton; a
text is accepted where the mandatory wording matches word for word up to its last word. License texts are whole: their
grant, conditions and disclaimer must all be there. Texts are lower-cased (A-Z) and cut into words of ASCII letters, digits and characters beyond ASCII, so
punctuation and line breaks don't matter. Automata start only at words that can begin a template.

Defined cases: null text counts as empty; an empty text has no words and no labels; repeated rows and null ids give a
row each; further columns are ignored. ``score`` is 1 when a template was accepted, else 0.5 when a phrase stands in
the text, else 0.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, bounded_batches

#: Phrases and labels of the base scan.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

_MIT_GRANT = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice <<opt including the next paragraph>> shall be included in all copies or substantial portions of the software"
_MIT_DISCLAIMER = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall <<opt the>> <<any 8>> be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
_BSD_GRANT = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met <<any 1>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer <<any 1>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_BSD_NAMES = "<<any 1>> neither the name of <<any 12>> nor the names of <<any 3>> contributors may be used to endorse or promote products derived from this software without specific prior written permission"
_BSD_DISCLAIMER = "this software is provided by <<any 12>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall <<any 12>> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
_ISC = "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and <<any 6>> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall <<any 6>> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"
_FREE = "this program is free software you can redistribute it and or modify it under the terms of the gnu {} as published by the free software foundation <<opt either>> version"
_SPDX = "spdx license identifier"

#: Label and template. Wording of public license notices and texts; a label with a version needs the version's words.
TEMPLATES = [
    ("apache-2.0", "licensed under <<opt the terms of>> the apache license <<opt the license>> version 2 0"),
    ("apache-2.0", f"{_SPDX} apache 2 0"),
    ("gpl", "this <<any 4>> is licensed under the gnu general public license"),
    ("lgpl", "this <<any 4>> is licensed under the gnu lesser general public license"),
    ("agpl", "this <<any 4>> is licensed under the gnu affero general public license"),
    ("gpl", _FREE.format("general public license")),
    ("lgpl", _FREE.format("lesser general public license")),
    ("agpl", _FREE.format("affero general public license")),
    ("gpl", f"{_SPDX} gpl <<any 1>> 0"),
    ("lgpl", f"{_SPDX} lgpl <<any 1>> <<any 1>>"),
    ("agpl", f"{_SPDX} agpl 3 0"),
    ("mit", "released under the mit license"),
    ("mit", f"{_MIT_GRANT} {_MIT_DISCLAIMER}"),
    ("mit", f"{_SPDX} mit <<not 0 advertising cmu enna feh festival khronos modern open testregex wu>>"),
    ("cc-by-nc-4.0", "licensed under <<opt the>> cc by nc <<opt license>> 4 0"),
    ("cc-by-4.0", "licensed under <<opt the>> cc by <<opt license>> 4 0"),
    ("cc-by-sa-4.0", "licensed under <<opt the>> cc by sa <<opt license>> 4 0"),
    ("cc-by-nd-4.0", "licensed under <<opt the>> cc by nd <<opt license>> 4 0"),
    ("cc-by-nc-sa-4.0", "licensed under <<opt the>> cc by nc sa <<opt license>> 4 0"),
    ("cc-by-nc-nd-4.0", "licensed under <<opt the>> cc by nc nd <<opt license>> 4 0"),
    ("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa-4.0", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("bsd-3-clause", f"{_BSD_GRANT} {_BSD_NAMES} {_BSD_DISCLAIMER}"),
    ("bsd-2-clause", f"{_BSD_GRANT} {_BSD_DISCLAIMER}"),
    ("bsd-2-clause", f"{_SPDX} bsd 2 clause <<not darwin first patent pkgconf views>>"),
    ("bsd-3-clause", f"{_SPDX} bsd 3 clause <<not acpica attribution clear flex hp lbnl modification no open sun>>"),
    ("isc", _ISC),
    ("isc", f"{_SPDX} isc <<not veillard>>"),
    ("all-rights-reserved", "<<opt copyright>> <<any 6>> all rights reserved"),
]

_SEP = rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"
_WORD = rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]"


class Automaton:
    """States are places between template elements; edges read one word, free edges read none."""

    def __init__(self, template: str):
        template, _, never = template.partition("<<not ")
        #: Words that may not come next.
        self.never = {w.encode() for w in never.rstrip("> ").split()}
        parts = re.findall(r"<<opt ([^>]*)>>|<<any (\d+)>>|(\S+)", template)
        self.read: list[dict] = [{}]
        self.anything: list[list[int]] = [[]]
        self.free: list[list[int]] = [[]]
        at = 0
        for optional, wild, word in parts:
            if word:
                at = self._word(at, word)
            elif optional:
                start = at
                for w in optional.split():
                    at = self._word(at, w)
                self.free[start].append(at)
            else:
                start = at
                ends = [at]
                for _ in range(int(wild)):
                    nxt = self._state()
                    self.anything[at].append(nxt)
                    at = nxt
                    ends.append(at)
                for e in [start, *ends[1:-1]]:
                    self.free[e].append(at)
        self.final = at
        self.first = self._closure({0})
        #: Words that can begin a match; a leading replaceable region is skipped, as any text may precede a match.
        self.begins = {w for s in self.first for w in self.read[s]}

    def _state(self) -> int:
        self.read.append({})
        self.anything.append([])
        self.free.append([])
        return len(self.read) - 1

    def _word(self, at: int, word: str) -> int:
        nxt = self._state()
        self.read[at].setdefault(word.encode(), []).append(nxt)
        return nxt

    def _closure(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for t in self.free[todo.pop()]:
                if t not in states:
                    states.add(t)
                    todo.append(t)
        return states

    def accepts(self, words: list[bytes], at: int) -> bool:
        """Whether the template matches words from position at on."""
        states = self.first
        while True:
            if self.final in states and not (at < len(words) and words[at] in self.never):
                return True
            if at == len(words) or not states:
                return False
            w = words[at]
            states = self._closure({t for s in states for t in (*self.read[s].get(w, ()), *self.anything[s])})
            at += 1


def compiled() -> list[tuple[str, Automaton]]:
    return [(label, Automaton(template)) for label, template in TEMPLATES]


#: Every template holds one of these words, so a text without them needs no words cut.
_HINT = re.compile(rb"licen[sc]e|reserved|redistribution|permission")
_PHRASES = [(label, re.compile(rb"(?<!" + _WORD + rb")" + _SEP.join(w.encode() for w in phrase.split()) + rb"(?!" + _WORD + rb")")) for phrase, label in PHRASES.items()]
_CUT = re.compile(_WORD + rb"+")


def scan(text: bytes, automata: list[tuple[str, Automaton]]) -> tuple[int, list[int], list[str], list[str], bool]:
    """n_words, word positions of the base phrases, base labels, all labels, and whether a template was accepted; text is lower-cased."""
    joined = np.frombuffer(text, np.uint8)
    inside = np.concatenate([[False], ALNUM[joined], [False]])
    starts = np.flatnonzero(inside[1:] & ~inside[:-1])
    places, base, labels = [], set(), set()
    for label, pattern in _PHRASES:
        found = [m.start() for m in pattern.finditer(text)]
        if found:
            base.add(label)
            places += np.searchsorted(starts, found).tolist()
    if _HINT.search(text):
        words = [b"license" if w == b"licence" else w for w in _CUT.findall(text)]
        begins: dict[bytes, list[int]] = {}
        for k, w in enumerate(words):
            begins.setdefault(w, []).append(k)
        for label, a in automata:
            if label not in labels and any(a.accepts(words, k) for w in a.begins for k in begins.get(w, ())):
                labels.add(label)
    return len(starts), places, sorted(base), sorted(base | labels), bool(labels)


_OUT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    automata = compiled()
    for batch in batches:
        rows: list[list] = [[] for _ in _ARROW.names]
        for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist(), strict=True):
            n, places, base, labels, matched = scan((raw or b"").lower(), automata)
            row = (doc, n, len(places), min(places, default=None), max(places, default=None), ",".join(base), ",".join(labels), 1.0 if matched else 0.5 if base else 0.0)
            for col, v in zip(rows, row, strict=True):
                col.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, _ARROW.types, strict=True)], schema=_ARROW)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")).mapInArrow(_scan_batches, _OUT)
