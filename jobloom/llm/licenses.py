"""License scans (operator 10): template markup compiled to token automata.

A template is wording with markup: ``<<optional>> ... <<end>>`` around words that may be missing, ``<<var;words=0-20>>`` for
replaceable words, ``<<any;a|b c|d>>`` for one of several wordings. It is compiled to an automaton over words; a place in
a text is accepted if the template's mandatory wording stands there exactly, word by word, from the template's first to
its last word. Punctuation, case of ASCII letters and line breaks never matter, since only words are compared.

Beside the templates, phrases of consecutive words give the base labels.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: the base phrases and their labels
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# fixed values: public license wordings, as templates
_BSD_DISCLAIMER = (
    "this software is provided by <<var;words=1-12>> as is and any express or implied warranties including but not limited to the implied "
    "warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall <<var;words=1-12>> be liable for any "
    "direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or "
    "services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict "
    "liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility "
    "of such damage"
)
TEMPLATES = {
    "mit-notice": "<<any;released|licensed|distributed|available|published>> under <<optional>>the terms of<<end>> the <<optional>>x11<<end>> mit license",
    "apache-2.0-notice": "licensed under the apache license <<optional>>version<<end>> 2 0",
    "gpl-2.0-notice": "licensed under <<optional>>the terms of<<end>> the gnu general public license <<any;version|v>> 2 <<optional>>or <<optional>>at your option<<end>> any later version<<end>>",
    "gpl-3.0-notice": "licensed under <<optional>>the terms of<<end>> the gnu general public license <<any;version|v>> 3 <<optional>>or <<optional>>at your option<<end>> any later version<<end>>",
    "lgpl-notice": "licensed under <<optional>>the terms of<<end>> the gnu <<any;lesser|library>> general public license <<optional>><<any;version|v>> <<any;2|2 1|3>><<end>>",
    "agpl-3.0-notice": "licensed under <<optional>>the terms of<<end>> the gnu affero general public license <<optional>><<any;version|v>> 3<<end>>",
    "mpl-2.0-notice": "subject to the terms of the mozilla public license <<any;v|version>> 2 0",
    "bsd-notice": "<<any;released|licensed|distributed>> under <<optional>>the terms of<<end>> the <<optional>><<any;2|3|two|three>> clause<<end>> <<any;bsd|new bsd|modified bsd|simplified bsd>> license",
    "cc-by-notice": "licensed under <<optional>>a<<end>> <<any;cc by|creative commons attribution>> <<optional>>international<<end>> <<any;2 0|2 5|3 0|4 0>>",
    "cc-by-sa-notice": "licensed under <<optional>>a<<end>> <<any;cc by sa|creative commons attribution sharealike|creative commons attribution share alike>> <<optional>>international<<end>> <<any;2 0|2 5|3 0|4 0>>",
    "cc-by-nc-notice": "licensed under <<optional>>a<<end>> <<any;cc by nc|creative commons attribution noncommercial|creative commons attribution non commercial>> <<optional>>international<<end>> <<any;2 0|2 5|3 0|4 0>>",
    "cc-by-nd-notice": "licensed under <<optional>>a<<end>> <<any;cc by nd|creative commons attribution noderivatives>> <<optional>>international<<end>> <<any;2 0|2 5|3 0|4 0>>",
    "spdx-tag": "spdx license identifier <<var;words=1-6>>",
    "mit-text": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
        "<<optional>>the software<<end>> to deal in the software without restriction including without limitation the rights to use copy modify "
        "merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
        "subject to the following conditions the above copyright notice and this permission notice <<optional>>including the next paragraph<<end>> "
        "shall be included in all copies or substantial portions of the software"
    ),
    "isc-text": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the "
        "above copyright notice and this permission notice appear in all copies"
    ),
    "bsd-text": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are "
        "met <<optional>>1<<end>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"
    ),
    "mit-full-text": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
        "<<optional>>the software<<end>> to deal in the software without restriction including without limitation the rights to use copy modify "
        "merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
        "subject to the following conditions the above copyright notice and this permission notice <<optional>>including the next paragraph<<end>> "
        "shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express "
        "or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event "
        "shall <<var;words=1-12>> be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from "
        "out of or in connection with the software or the use or other dealings in the software"
    ),
    "isc-full-text": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the "
        "above copyright notice and this permission notice appear in all copies the software is provided as is and <<var;words=1-12>> disclaims all "
        "warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall <<var;words=1-12>> "
        "be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits "
        "whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"
    ),
    "bsd-2-clause-text": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are "
        "met <<optional>>1<<end>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "<<optional>>2<<end>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer "
        "in the documentation and or other materials provided with the distribution "
        + _BSD_DISCLAIMER
    ),
    "bsd-3-clause-text": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are "
        "met <<optional>>1<<end>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "<<optional>>2<<end>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer "
        "in the documentation and or other materials provided with the distribution <<optional>>3<<end>> neither the name of <<var;words=1-12>> nor the "
        "names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission "
        + _BSD_DISCLAIMER
    ),
    "zlib-text": (
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising "
        "from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to "
        "alter it and redistribute it freely subject to the following restrictions <<optional>>1<<end>> the origin of this software must not be "
        "misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product "
        "documentation would be appreciated but is not required <<optional>>2<<end>> altered source versions must be plainly marked as such and must not "
        "be misrepresented as being the original software <<optional>>3<<end>> this notice may not be removed or altered from any source distribution"
    ),
    "unlicense-text": (
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute "
        "this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"
    ),
    "apache-2.0-header": (
        "licensed under the apache license version 2 0 the license you may not use <<any;this file|this work|this software|these files>> except in compliance with the license you "
        "may obtain a copy of the license at <<optional>><<any;http|https>><<end>> www apache org licenses license 2 0 unless required by applicable law "
        "or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind "
        "either express or implied see the license for the specific language governing permissions and limitations under the license"
    ),
    "mpl-2.0-header": (
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you "
        "can obtain one at <<any;http|https>> <<optional>>www<<end>> mozilla org mpl 2 0"
    ),
}

_BLANK = bytes(32 if b < 0x30 or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b + 32 if 65 <= b <= 90 else b for b in range(256))
_MARK = re.compile(r"<<(.*?)>>")


def words_of(text: str | None) -> list[bytes]:
    """Words of the text with A-Z in lower case: runs of ASCII digits and letters and of all other non-ASCII characters."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_BLANK).split()


class Template:
    """An automaton: ``step[state]`` maps a word to next states, ``any_[state]`` are next states by any word."""

    def __init__(self, name: str, markup: str):
        self.name = name
        self.step: list[dict[bytes, set[int]]] = [{}]
        self._any: list[set[int]] = [set()]
        self._free: list[set[int]] = [set()]
        end, opened, at = 0, [], 0
        for mark in [*_MARK.finditer(markup), None]:
            end = self._words(end, markup[at : mark.start() if mark else None])
            if mark is None:
                break
            at, kind = mark.end(), mark.group(1).strip()
            if kind == "optional":
                opened.append(end)
            elif kind == "end":
                start = opened.pop()
                end = self._join([start, end])
            elif kind.startswith("var"):
                least, most = (int(x) for x in re.search(r"words=(\d+)-(\d+)", kind).groups())
                exits = [end] if least == 0 else []
                for k in range(most):
                    new = self._state()
                    self._any[end].add(new)
                    end = new
                    if k + 1 >= least:
                        exits.append(end)
                end = self._join(exits)
            elif kind.startswith("any;"):
                end = self._join([self._words(end, choice) for choice in kind[4:].split("|")])
            else:
                raise ValueError(f"unknown markup <<{kind}>> in {name}")
        if opened:
            raise ValueError(f"optional wording isn't ended in {name}")
        self.accept = end
        self._closed = [self._closure(s) for s in range(len(self.step))]
        if self.accept in self._closed[0]:
            raise ValueError(f"{name} has no mandatory wording")
        if any(self._any[s] for s in self._closed[0]):
            raise ValueError(f"{name} begins with replaceable wording")
        self.first = {w for s in self._closed[0] for w in self.step[s]}

    def _state(self) -> int:
        self.step.append({})
        self._any.append(set())
        self._free.append(set())
        return len(self.step) - 1

    def _words(self, state: int, text: str) -> int:
        for word in words_of(text):
            new = self._state()
            self.step[state].setdefault(word, set()).add(new)
            state = new
        return state

    def _join(self, states: list[int]) -> int:
        new = self._state()
        for s in states:
            self._free[s].add(new)
        return new

    def _closure(self, state: int) -> frozenset[int]:
        seen, todo = {state}, [state]
        while todo:
            for s in self._free[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)

    def match(self, words: list[bytes], start: int) -> int | None:
        """The end of the longest accepted wording that begins at ``start``, else None."""
        states, end = self._closed[0], None
        for k in range(start, len(words)):
            after: set[int] = set()
            for s in states:
                for t in self.step[s].get(words[k], ()):
                    after |= self._closed[t]
                for t in self._any[s]:
                    after |= self._closed[t]
            if not after:
                break
            if self.accept in after:
                end = k + 1
            states = after
        return end


class Scanner:
    """All phrases and templates at once; a place is tried only where a template's first word stands."""

    def __init__(self, templates: dict[str, str], phrases: dict[str, str]):
        self._first: dict[bytes, list[Template]] = {}
        for t in (Template(n, m) for n, m in templates.items()):
            for w in t.first:
                self._first.setdefault(w, []).append(t)
        self._phrases: dict[bytes, list[tuple[list[bytes], str]]] = {}
        for phrase, label in phrases.items():
            own = words_of(phrase)
            self._phrases.setdefault(own[0], []).append((own, label))
        self._starts = frozenset([*self._first, *self._phrases])

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int, str]], list[tuple[int, str]]]:
        """Accepted places (start, end, template) and places of phrases (start, label)."""
        places, base = [], []
        if self._starts.isdisjoint(words):
            return places, base
        starts = self._starts
        for i in [i for i, w in enumerate(words) if w in starts]:
            for phrase, label in self._phrases.get(words[i], ()):
                if words[i : i + len(phrase)] == phrase:
                    base.append((i, label))
            for template in self._first.get(words[i], ()):
                if (end := template.match(words, i)) is not None:
                    places.append((i, end, template.name))
        return places, base


_RESULT = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "matches array<struct<template:string,start_word:long,end_word:long>>"
)


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None, text: str = "text") -> DataFrame:
    """Every row, without its text, with its license findings.

    n_words, n_base (places of phrases), first_word and last_word (least and greatest start of those, null if none),
    base_labels, labels (those and the accepted templates' names; distinct, sorted, joined by commas), score (1 if a
    template is accepted, 0.5 if only a phrase stands there, else 0) and matches (template, first word, word after the
    last). Null and empty texts have no words and no labels. Repeated rows stay; columns of these names are replaced.
    """
    templates, phrases = TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases

    @F.pandas_udf(_RESULT)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(templates, phrases)
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"]
        for batch in batches:
            rows = []
            for t in batch:
                words = words_of(t)
                places, base = scanner.scan(words)
                own = {label for _, label in base}
                every = own | {name for _, _, name in places}
                at = [i for i, _ in base]
                rows.append((len(words), len(base), min(at, default=None), max(at, default=None), ",".join(sorted(own)), ",".join(sorted(every)), 1.0 if places else 0.5 if base else 0.0, [(n, a, b) for a, b, n in places]))
            out = pd.DataFrame(rows, columns=names)
            yield out.astype({"first_word": "Int64", "last_word": "Int64"})

    out = docs.withColumn("_scan", scan(F.col(text)))
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"]
    return out.withColumns({n: F.col(f"_scan.{n}") for n in names}).drop("_scan", *([text] if text not in names else []))
