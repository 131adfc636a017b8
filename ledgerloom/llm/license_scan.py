"""License scan by template-markup matching.

Templates are texts with optional regions, ``<<beginOptional>>`` ... ``<<endOptional>>`` (they nest), and replaceable
ones, ``<<var;words=min-max>>``. Each template is compiled into a token automaton: a state for each word, empty steps
around optional regions, and free words in replaceable ones. A text has a license where an automaton reads from some
word of it to its end, that is, where all mandatory wording stands there exactly, in order, word by word. The
templates are a parameter; ``templates_of`` takes them from a table. By default they are those of short notices and of
whole licenses.

Score: 0.5 for phrases alone; where an automaton reads, 0.5 + half the greatest share that a reading has of its
template's words, optional and replaceable ones included. So a whole license has 1 and a notice without its optional words less.

Words are runs of a-z (after A-Z are lower-cased), 0-9 and characters beyond ASCII. Beside the templates, the places
of fixed phrases are counted. Null and empty texts have no words, places or labels. Rows are judged one by one,
so repeated rows give the same answer each.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns_of

# The phrases and labels of the base count.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Wording of public license notices, in the markup described above.
TEMPLATES = {
    "mit": "<<beginOptional>>is<<endOptional>> released under the MIT License",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
                "associated documentation files (the <<var;words=1-3>>), to deal in <<beginOptional>>the Software"
                "<<endOptional>> without restriction",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 <<beginOptional>>(the License); you may not use "
                  "this file except in compliance with the License<<endOptional>>",
    "cc-by-4.0": "<<beginOptional>>is<<endOptional>> licensed under <<beginOptional>>a<<endOptional>> "
                 "<<beginOptional>>Creative Commons<<endOptional>> CC BY <<beginOptional>>International<<endOptional>> 4.0",
    "cc-by-nc-4.0": "licensed under <<beginOptional>>a<<endOptional>> CC BY-NC 4.0 <<beginOptional>>International<<endOptional>>",
    "cc-by-sa-4.0": "licensed under <<beginOptional>>a<<endOptional>> CC BY-SA 4.0 <<beginOptional>>International<<endOptional>>",
    "gpl-2.0": "licensed under the <<beginOptional>>terms of the<<endOptional>> GNU General Public License "
               "<<beginOptional>>as published by the Free Software Foundation<<endOptional>> <<beginOptional>>either<<endOptional>> version 2",
    "gpl-3.0": "licensed under the <<beginOptional>>terms of the<<endOptional>> GNU General Public License "
               "<<beginOptional>>as published by the Free Software Foundation<<endOptional>> <<beginOptional>>either<<endOptional>> version 3",
    "gpl-notice": "redistribute it and/or modify it under the terms of the GNU General Public License as published by "
                  "the Free Software Foundation; either version <<var;words=1-2>> of the License",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
           "the following conditions are met <<beginOptional>>Redistributions of source code must retain the above "
           "copyright notice<<endOptional>>",
    "mpl-2.0": "subject to the terms of the Mozilla Public License, v. 2.0",
    "unlicense": "This is free and unencumbered software released into the public domain",
}

# Wording of whole public licenses, in the same markup.
_NO_WARRANTY = ("THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES "
                "OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE <<var;words=1-6>> BE LIABLE "
                "FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
                "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE")
_BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: <<beginOptional>>1<<endOptional>> Redistributions of source code must retain the above copyright notice, this "
        "list of conditions and the following disclaimer. <<beginOptional>>2<<endOptional>> Redistributions in binary form must reproduce "
        "the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials "
        "provided with the distribution. ")
_BSD_NAMES = ("<<beginOptional>>3<<endOptional>> Neither the name of <<var;words=1-12>> nor the names of its contributors may be used to "
              "endorse or promote products derived from this software without specific prior written permission. ")
_BSD_NO_WARRANTY = ("THIS SOFTWARE IS PROVIDED BY <<var;words=1-8>> AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, "
                    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL "
                    "<<var;words=1-8>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
                    "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
                    "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING "
                    "NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE")
TEMPLATES |= {
    "mit-whole": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
                 "files (the <<var;words=1-3>>), to deal in the Software without restriction, including without limitation the rights to use, "
                 "copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
                 "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice "
                 "<<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial portions of "
                 "the Software. " + _NO_WARRANTY,
    "isc-whole": "Permission to use, copy, modify, <<beginOptional>>and<<endOptional>> <<beginOptional>>or<<endOptional>> distribute this "
                 "software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission "
                 "notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND <<var;words=1-6>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS "
                 "SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var;words=1-6>> BE LIABLE FOR ANY "
                 "SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
                 "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
                 "PERFORMANCE OF THIS SOFTWARE",
    "bsd-2-clause-whole": _BSD + _BSD_NO_WARRANTY,
    "bsd-3-clause-whole": _BSD + _BSD_NAMES + _BSD_NO_WARRANTY,
    "zlib-whole": "This software is provided as is, without any express or implied warranty. In no event will <<var;words=1-6>> be held liable "
                  "for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, "
                  "including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
                  "<<beginOptional>>1<<endOptional>> The origin of this software must not be misrepresented; you must not claim that you wrote "
                  "the original software. If you use this software in a product, an acknowledgment in the product documentation would be "
                  "appreciated but is not required. <<beginOptional>>2<<endOptional>> Altered source versions must be plainly marked as such, and "
                  "must not be misrepresented as being the original software. <<beginOptional>>3<<endOptional>> This notice may not be removed "
                  "or altered from any source distribution",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the "
                         "License. You may obtain a copy of the License at http www apache org licenses LICENSE 2 0 Unless required by applicable "
                         "law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES "
                         "OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions "
                         "and limitations under the License",
}

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_MARK = re.compile(r"<<(beginOptional|endOptional|var;words=(\d+)-(\d+))>>")


@dataclass
class Automaton:
    """Steps by a word, steps by any word, and empty steps between numbered states; state 0 starts, ``end`` accepts."""

    words: list[dict[bytes, int]] = field(default_factory=list)
    free: list[int | None] = field(default_factory=list)
    empty: list[list[int]] = field(default_factory=list)
    end: int = 0
    longest: int = 0  # words, with all optional and replaceable ones

    def add(self) -> int:
        self.words.append({})
        self.free.append(None)
        self.empty.append([])
        return len(self.words) - 1

    def close(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for to in self.empty[todo.pop()]:
                if to not in states:
                    states.add(to)
                    todo.append(to)
        return states

    def first_words(self) -> set[bytes]:
        """The words that it may begin with; b"" stands for any."""
        first = self.close({0})
        return {w for s in first for w in self.words[s]} | ({b""} if any(self.free[s] is not None for s in first) else set())

    def mandatory(self) -> set[bytes]:
        """The words on every way to the end: without them it is not reached."""
        def reached(without: bytes) -> bool:
            seen, todo = set(), [0]
            while todo:
                s = todo.pop()
                if s in seen:
                    continue
                seen.add(s)
                todo += [*self.empty[s], *([] if self.free[s] is None else [self.free[s]]), *[to for w, to in self.words[s].items() if w != without]]
            return self.end in seen

        return {w for w in {w for step in self.words for w in step} if not reached(w)}

    def words_read(self, text: list[bytes], at: int) -> int:
        """How many words the longest reading from the word ``at`` has; 0 if it doesn't get to the end."""
        states, n, read = self.close({0}), 0, 0
        while states:
            if self.end in states:
                read = n
            if at + n == len(text):
                break
            w = text[at + n]
            step = {to for s in states if (to := self.words[s].get(w)) is not None}
            step |= {to for s in states if (to := self.free[s]) is not None}
            states, n = self.close(step), n + 1
        return read

    def accepts_at(self, text: list[bytes], at: int) -> bool:
        return self.words_read(text, at) > 0


def compile_template(markup: str) -> Automaton:
    a = Automaton()
    now, at, opened = a.add(), 0, []

    def wording(part: str, now: int) -> int:
        for w in _WORD.findall(part.encode().translate(_LOWER)):
            a.longest += 1
            to = a.add()
            a.words[now][w] = to
            now = to
        return now

    for m in _MARK.finditer(markup):
        now, at = wording(markup[at:m.start()], now), m.end()
        if m[1] == "beginOptional":
            to = a.add()  # a region's own state, so that leaving it out never mixes with the word before
            a.empty[now].append(to)
            opened.append(to)
            now = to
        elif m[1] == "endOptional":
            to = a.add()
            a.empty[now].append(to)
            a.empty[opened.pop()].append(to)
            now = to
        else:
            least, most = int(m[2]), int(m[3])
            a.longest += most
            behind = a.add()
            for k in range(most):
                if k >= least:
                    a.empty[now].append(behind)
                to = a.add()
                a.free[now] = to
                now = to
            a.empty[now].append(behind)
            now = behind
    if opened:
        raise ValueError("an optional region is not closed")
    a.end = wording(markup[at:], now)
    if 0 in a.close({0}) and a.end in a.close({0}):
        raise ValueError("a template needs mandatory wording")
    return a


@lru_cache(maxsize=8)
def _compiled(templates: tuple[tuple[str, str], ...]) -> tuple[dict[bytes, list[tuple[str, Automaton]]], re.Pattern]:
    """Automata by their first words, and a search for those words."""
    starts: dict[bytes, list[tuple[str, Automaton]]] = {}
    mandatory = []
    for label, markup in templates:
        a = compile_template(markup)
        for w in a.first_words():
            starts.setdefault(w, []).append((label, a))
        if not (words := a.mandatory()):
            raise ValueError(f"the template of {label} needs a word that no region may leave out")
        mandatory.append(max(sorted(words), key=len))
    if not mandatory:
        return starts, re.compile(rb"(?!)")
    return starts, re.compile(rb"(?<![0-9a-z\x80-\xff])(?:" + b"|".join(sorted(set(mandatory))) + rb")(?![0-9a-z\x80-\xff])")


@lru_cache(maxsize=8)
def _phrase_patterns(phrases: tuple[tuple[str, str], ...]) -> list[tuple[str, re.Pattern]]:
    """Places may overlap, so a match is looked ahead for."""
    gap = rb"[^0-9a-z\x80-\xff]+"
    return [(label, re.compile(rb"(?<![0-9a-z\x80-\xff])(?=" + gap.join(map(re.escape, _WORD.findall(phrase.encode().translate(_LOWER))))
                               + rb"(?![0-9a-z\x80-\xff]))")) for phrase, label in phrases]


def scan_text(text: bytes, templates=tuple(TEMPLATES.items()), phrases=tuple(PHRASES.items())) -> tuple:
    """(words, places of phrases, first place, last place, labels of phrases, all labels, score) of UTF-8 bytes."""
    low = text.translate(_LOWER)
    is_word = _IS_WORD[np.frombuffer(low, dtype=np.uint8)]
    begins = is_word.copy()
    begins[1:] &= ~is_word[:-1]
    n = int(np.count_nonzero(begins))
    places: list[int] = []
    base: set[str] = set()
    for label, pattern in _phrase_patterns(phrases):
        if found := [m.start() for m in pattern.finditer(low)]:
            places += found
            base.add(label)
    starts, likely = _compiled(templates)
    labels: dict[str, float] = {}  # with the greatest share of the template that is read
    if likely.search(low):
        words, anywhere = _WORD.findall(low), starts.get(b"", ())
        for at, w in enumerate(words):
            for label, automaton in (*starts.get(w, ()), *anywhere):
                if labels.get(label, 0.0) < 1 and (read := automaton.words_read(words, at)):
                    labels[label] = max(labels.get(label, 0.0), read / automaton.longest)
    at = [int(np.count_nonzero(begins[:p + 1])) - 1 for p in (min(places), max(places))] if places else [None, None]
    score = 0.5 + max(labels.values()) / 2 if labels else 0.5 if base else 0.0
    return n, len(places), *at, ",".join(sorted(base)), ",".join(sorted(base | labels.keys())), score


def templates_of(table: DataFrame, label_col: str = "label", markup_col: str = "markup", most_chars: int = 20_000_000) -> dict[str, str]:
    """The templates of a table, for ``scan_licenses``. They go to every task, so together they may have at most ``most_chars``
    characters. Rows with a null are left out; a label that has several markups is refused."""
    t = columns_of(table, label_col, markup_col).toDF("label", "markup").dropna().distinct()
    size = t.agg(F.sum(F.length("label") + F.length("markup"))).first()[0] or 0
    if size > most_chars:
        raise ValueError(f"templates have {size} characters, more than {most_chars}")
    rows = t.orderBy("label", "markup").collect()
    if len({r["label"] for r in rows}) < len(rows):
        raise ValueError("a label has several templates")
    return {r["label"]: r["markup"] for r in rows}


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_words, n_base, first_word, last_word, base_labels, labels and score of each document."""
    marks = (tuple((TEMPLATES if templates is None else templates).items()), tuple((PHRASES if phrases is None else phrases).items()))
    d = columns_of(docs, id_col, text_col).toDF("id", "text").select(F.col("id").cast("long").alias("id"), F.col("text").cast("binary").alias("text"))
    names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]

    def run(batches):
        for batch in batches:
            rows = [scan_text(x.as_py() or b"", *marks) for x in batch.column("text")]
            cols = zip(*rows, strict=True) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column("id"), *[pa.array(list(c), t) for c, t in zip(cols, types, strict=True)]],
                                             names=["id", *names])

    out = d.mapInArrow(run, "id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
    return out.withColumnRenamed("id", id_col)
