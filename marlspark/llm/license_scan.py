"""License scans: template markup compiled into token automata.

A template is plain license wording with two kinds of marked regions:
``<<beginOptional>>...<<endOptional>>`` may be absent, and
``<<var;name=...;match=a|b>>`` or ``<<var;name=...;words=0-9>>`` stands for one
of the listed words or for any words of the given number. All other wording is
mandatory and must match word for word. A template is compiled into a
bit-parallel automaton over tokens: one bit per position, a transition mask per
token and an epsilon mask per position.

The score is 1 if a template accepts a part of the text, 0.5 if there is only a
phrase of the base scan, else 0.

Defined cases: a null or empty text has no words, no places, empty labels and
score 0. Repeated rows are scored each on their own. An empty table gives no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import by_batch, utf8

# The phrases of the base scan and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# License notices and texts, as public wording with template markup.
TEMPLATES = {
    "gpl-notice": "licensed under <<beginOptional>>the terms of <<endOptional>><<beginOptional>>the <<endOptional>>GNU General Public License<<beginOptional>> as published by the Free Software Foundation<<endOptional>><<beginOptional>> either<<endOptional>><<beginOptional>> version <<var;name=version;words=1-2>><<endOptional>><<beginOptional>> or any later version<<endOptional>><<beginOptional>> or at your option any later version<<endOptional>>",
    "lgpl-notice": "licensed under <<beginOptional>>the terms of <<endOptional>><<beginOptional>>the <<endOptional>>GNU <<var;name=kind;match=lesser|library>> General Public License<<beginOptional>> version <<var;name=version;words=1-2>><<endOptional>>",
    "agpl-notice": "licensed under <<beginOptional>>the terms of <<endOptional>><<beginOptional>>the <<endOptional>>GNU Affero General Public License<<beginOptional>> version <<var;name=version;words=1-2>><<endOptional>>",
    "apache-2.0-notice": "licensed under the Apache License<<beginOptional>> Version<<endOptional>> 2.0<<beginOptional>> the License you may not use this file except in compliance with the License<<endOptional>>",
    "cc-by-notice": "licensed under <<beginOptional>>a <<endOptional>><<beginOptional>>the <<endOptional>><<var;name=body;match=cc|creative commons>> <<var;name=kind;match=by|attribution>> <<var;name=version;match=1.0|2.0|2.5|3.0|4.0>><<beginOptional>> international<<endOptional>><<beginOptional>> license<<endOptional>>",
    "cc-by-nc-notice": "licensed under <<beginOptional>>a <<endOptional>><<beginOptional>>the <<endOptional>><<var;name=body;match=cc|creative commons>> <<var;name=kind;match=by nc|attribution noncommercial>> <<var;name=version;match=1.0|2.0|2.5|3.0|4.0>><<beginOptional>> international<<endOptional>><<beginOptional>> license<<endOptional>>",
    "cc-by-sa-notice": "licensed under <<beginOptional>>a <<endOptional>><<beginOptional>>the <<endOptional>><<var;name=body;match=cc|creative commons>> <<var;name=kind;match=by sa|attribution sharealike>> <<var;name=version;match=1.0|2.0|2.5|3.0|4.0>><<beginOptional>> international<<endOptional>><<beginOptional>> license<<endOptional>>",
    "cc-by-nd-notice": "licensed under <<beginOptional>>a <<endOptional>><<beginOptional>>the <<endOptional>><<var;name=body;match=cc|creative commons>> <<var;name=kind;match=by nd|attribution noderivatives>> <<var;name=version;match=1.0|2.0|2.5|3.0|4.0>><<beginOptional>> international<<endOptional>><<beginOptional>> license<<endOptional>>",
    "mit-notice": "<<var;name=verb;match=licensed|released|distributed|available>> under <<beginOptional>>the terms of <<endOptional>>the MIT License",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph) <<endOptional>>shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<var;name=holder;words=1-8>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "isc-text": "Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND <<var;name=author;words=1-8>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var;name=liable;words=1-8>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "bsd-2-clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: <<var;name=bullet1;words=0-1>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. <<var;name=bullet2;words=0-1>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY <<var;name=providers;words=1-12>> \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<var;name=liable;words=1-12>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "bsd-3-clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: <<var;name=bullet1;words=0-1>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. <<var;name=bullet2;words=0-1>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. <<var;name=bullet3;words=0-1>> Neither the name of <<var;name=holder;words=1-12>> nor the names of <<beginOptional>>its <<endOptional>>contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY <<var;name=providers;words=1-12>> \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<var;name=liable;words=1-12>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "gpl-header": "<<var;name=program;match=this program|this file|this software|this library>> is free software you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation<<var;name=kind;match= either version 2| either version 3| version 2| version 3>> of the License<<beginOptional>>, or (at your option) any later version<<endOptional>>. <<var;name=program2;match=this program|this file|this software|this library>> is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at <<var;name=scheme;match=http|https>>://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at <<var;name=scheme;match=http|https>>://mozilla.org/MPL/2.0/.",
    "all-rights-reserved": "All rights reserved",
}

_MARK = re.compile(r"<<(beginOptional|endOptional|var;[^>]*)>>")
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """A-Z lower-cased; maximal runs of 0-9, a-z and all non-ASCII characters."""
    return text.translate(_FOLD).split()


@dataclass
class Automaton:
    """Bit i set: the next token is matched against position i. Bit ``size`` set: accepted."""

    label: str
    size: int = 0
    literal: dict[bytes, int] = field(default_factory=dict)
    anything: int = 0
    skips: list[int] = field(default_factory=list)  # for each position, those reached without a token
    step: dict[int, int] = field(default_factory=dict)  # where a matched position leads, if not to the next

    def start(self) -> int:
        return self.skips[0] | 1

    def first(self) -> frozenset[bytes]:
        """Tokens that can begin a match."""
        if self.start() & self.anything:
            raise ValueError(f"{self.label}: a template must not begin with a free region")
        return frozenset(t for t, m in self.literal.items() if m & self.start())

    def longest(self, words: list[bytes], at: int) -> int:
        """The end of the longest match that begins at word ``at``, or ``at`` if there is none."""
        state, best, accept = self.start(), at, 1 << self.size
        while state:
            if state & accept:
                best = at
            if at == len(words):
                break
            hit, state = state & (self.literal.get(words[at], 0) | self.anything), 0
            at += 1
            while hit:
                low = hit & -hit
                hit ^= low
                i = self.step.get(b := low.bit_length() - 1, b + 1)
                state |= 1 << i | self.skips[i]
        return best


def compile_template(label: str, markup: str) -> Automaton:
    """The automaton of one template. Raises ValueError on unbalanced markup."""
    made, edges, opened, at = Automaton(label), [], [], 0

    def literals(text: str) -> None:
        for word in words_of(text.encode()):
            made.literal[word] = made.literal.get(word, 0) | 1 << made.size
            made.size += 1

    for mark in [*_MARK.finditer(markup), None]:
        literals(markup[at : mark.start() if mark else len(markup)])
        if mark is None:
            break
        at = mark.end()
        if mark[1] == "beginOptional":
            opened.append(made.size)
        elif mark[1] == "endOptional":
            if not opened:
                raise ValueError(f"{label}: endOptional without beginOptional")
            edges.append((opened.pop(), made.size))
        elif (spec := dict(x.split("=", 1) for x in mark[1].split(";")[1:])).get("words"):
            low, high = map(int, spec["words"].split("-"))
            for i in range(high):
                made.anything |= 1 << made.size
                if i >= low:
                    edges.append((made.size, None))
                made.size += 1
            edges = [(a, made.size if b is None else b) for a, b in edges]
        else:
            begin, ends, options = made.size, [], [words_of(x.encode()) for x in spec["match"].split("|")]
            for option in options:
                if made.size > begin:
                    edges.append((begin, made.size))
                for word in option:
                    made.literal[word] = made.literal.get(word, 0) | 1 << made.size
                    made.size += 1
                ends.append(made.size - 1)
            made.step.update({e: made.size for e in ends})
    if opened:
        raise ValueError(f"{label}: beginOptional without endOptional")
    made.skips = [0] * (made.size + 1)
    for _ in range(made.size + 1):  # closure; edges only lead forward
        before = list(made.skips)
        for a, b in edges:
            made.skips[a] |= 1 << b | made.skips[b]
        if before == made.skips:
            break
    return made


def template_places(words: list[bytes], automata: list[Automaton], starts: dict[bytes, list[int]]) -> list[tuple[int, int, str]]:
    """(start, end, label) of each template's leftmost longest matches that do not overlap one another."""
    found, free = [], [0] * len(automata)
    for at, word in enumerate(words):
        for k in starts.get(word, ()):
            if at >= free[k] and (end := automata[k].longest(words, at)) > at:
                found.append((at, end, automata[k].label))
                free[k] = end
    return found


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, base: dict[str, str] = BASE) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: base places, labels, score, and in ``matches`` each template match as ``label:first word:end word``."""
    automata = [compile_template(k, v) for k, v in templates.items()]
    starts: dict[bytes, list[int]] = {}
    for k, a in enumerate(automata):
        for word in a.first():
            starts.setdefault(word, []).append(k)
    phrases = [(b" " + b" ".join(words_of(p.encode())) + b" ", label) for p, label in base.items()]
    needed = sorted({max((w for w in a.literal if _always(a, w)), key=len, default=b"") for a in automata})

    def one(text: bytes) -> tuple:
        words = words_of(text)
        joined = b" " + b" ".join(words) + b" "
        places = []
        for phrase, label in phrases:
            at, first, counted = joined.find(phrase), 0, 0
            while at >= 0:
                first, counted = first + joined.count(b" ", counted, at), at
                places.append((first, first + phrase.count(b" ") - 1, label))
                at = joined.find(phrase, at + 1)
        found = template_places(words, automata, starts) if any(w in joined for w in needed) else []
        named = sorted({x[2] for x in places})
        return (len(words), len(places), min((x[0] for x in places), default=None), max((x[0] for x in places), default=None), ",".join(named), ",".join(sorted({*named, *(x[2] for x in found)})), 1.0 if found else 0.5 if places else 0.0, [f"{n}:{a}:{b}" for a, b, n in found])

    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"]

    def batch(rows: pa.RecordBatch) -> dict:
        cols = zip(*map(one, rows.column("text").to_pylist()), strict=True) if rows.num_rows else [[]] * len(names)
        return {"doc_id": rows.column("doc_id")} | {k: list(v) for k, v in zip(names, cols, strict=True)}

    return by_batch(docs.select(docs["doc_id"].cast("long").alias("doc_id"), utf8("text")), batch, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<string>")


def _always(a: Automaton, word: bytes) -> bool:
    """Whether every match holds the word: without it no match is left."""
    rest = Automaton(a.label, a.size, {w: m for w, m in a.literal.items() if w != word}, a.anything, a.skips, a.step)
    state, reached = rest.start(), rest.start()
    usable = rest.anything
    for m in rest.literal.values():
        usable |= m
    while state:
        low = state & -state
        state ^= low
        i = low.bit_length() - 1
        if i < a.size and usable >> i & 1:
            j = a.step.get(i, i + 1)
            state |= (new := (1 << j | a.skips[j]) & ~reached)
            reached |= new
    return not reached >> a.size & 1


def template_pattern(markup: str) -> str:
    """The template as a regular expression over words that each end with a space; for SQL, and to test the automata."""
    out, at = [], 0

    def literals(text: str) -> str:
        return "".join(f"{w.decode()} " for w in words_of(text.encode()))

    for mark in [*_MARK.finditer(markup), None]:
        out.append(literals(markup[at : mark.start() if mark else len(markup)]))
        if mark is None:
            return "".join(out)
        at = mark.end()
        if mark[1] == "beginOptional":
            out.append("(?:")
        elif mark[1] == "endOptional":
            out.append(")?")
        else:
            spec = dict(x.split("=", 1) for x in mark[1].split(";")[1:])
            out.append("(?:[^ ]+ ){%s}" % spec["words"].replace("-", ",") if "words" in spec else "(?:%s)" % "|".join(literals(x) for x in spec["match"].split("|")))


def sql(templates: dict[str, str] = TEMPLATES, base: dict[str, str] = BASE) -> str:
    """``scan`` for DuckDB over ``documents``, without ``matches``."""
    upper = "".join(map(chr, range(65, 91)))
    longest = max(len(p.split()) for p in base)
    ahead = ", ".join(f"lead(w0, {k}) over (partition by r order by i) w{k}" for k in range(1, longest))
    places = "\n union all ".join(f"select r, i, '{label}' label from pos where " + " and ".join(f"w{k} = '{w}'" for k, w in enumerate(phrase.split())) for phrase, label in base.items())
    matched = "\n union all ".join(f"select r, '{label}' label from w where regexp_matches(joined, ' {template_pattern(markup)}')" for label, markup in templates.items())
    return f"""
with d as (select row_number() over () r, doc_id, regexp_replace(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g') t from documents),
w as (select r, doc_id, words, ' ' || array_to_string(words, ' ') || ' ' joined from (select *, list_filter(string_split(t, ' '), lambda x: x <> '') words from d)),
pos as (select *, {ahead} from (select r, unnest(words) w0, unnest(range(len(words))) i from w)),
p as ({places}),
b as (select r, count(*) n, min(i) lo, max(i) hi, string_agg(distinct label, ',' order by label) labels from p group by r),
m as ({matched}),
a as (select r, string_agg(distinct label, ',' order by label) labels from (select r, label from p union all select r, label from m) group by r)
select doc_id, len(words)::bigint n_words, coalesce(n, 0)::bigint n_base, lo::bigint first_word, hi::bigint last_word, coalesce(b.labels, '') base_labels, coalesce(a.labels, '') labels,
  case when r in (select r from m) then 1.0::double when n > 0 then 0.5::double else 0.0::double end score
from w left join b using (r) left join a using (r)"""
