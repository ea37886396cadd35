"""License scan with a positional index of rare words.

The index maps each word of the license templates to (template, position).  Counts of the whole corpus
give each word's IDF.  Of a file the highest-IDF words of each template that may be in it are looked
up; their postings are intersected by relative position (the place in the file less the place in the
template), so that words which stand to one another as in the template meet.  Such a place is verified
by the template's mandatory key phrases and scored by the share of the template that stands around it.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, bounded_batches, lean, text_chunks

# Base phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


@dataclass(frozen=True)
class Template:
    """A license's text, or a sentence that names it, and the phrases that must stand there."""

    label: str
    text: str
    keys: tuple[str, ...]


# Public license texts and notices, without the lines that name their holders, and sentences.
_NO_WARRANTY = (
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a"
    " particular purpose and noninfringement"
)
_BSD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source"
    " code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright"
    " notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
)
_BSD_END = (
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties"
    " of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect"
    " incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business"
    " interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the"
    " use of this software even if advised of the possibility of such damage"
)
_GNU = (
    "{it} is free software you can redistribute it and or modify it under the terms of the gnu {name} as published by the free software foundation either version {version}"
    " of the license or at your option any later version {it} is distributed in the hope that it will be useful but without any warranty without even the implied warranty"
    " of merchantability or fitness for a particular purpose see the gnu {name} for more details you should have received a copy of the gnu {name} along with {it}"
)
TEMPLATES = [
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software"
        " without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit"
        " persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in"
        f" all copies or substantial portions of the software {_NO_WARRANTY} in no event shall the authors or copyright holders be liable for any claim damages or other"
        " liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
        ("permission is hereby granted free of charge", "without restriction"),
    ),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this"
        " permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied"
        " warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever"
        " resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or"
        " performance of this software",
        ("permission to use copy modify", "with or without fee"),
    ),
    Template("bsd", f"{_BSD} {_BSD_END}", ("redistribution and use in source and binary forms",)),
    Template(
        "bsd-3-clause",
        f"{_BSD} neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without"
        f" specific prior written permission {_BSD_END}",
        ("redistribution and use in source and binary forms", "endorse or promote products derived from this software"),
    ),
    Template(
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this"
        " software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject"
        " to the following restrictions the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this"
        " software in a product an acknowledgment in the product documentation would be appreciated but is not required altered source versions must be plainly marked as"
        " such and must not be misrepresented as being the original software this notice may not be removed or altered from any source distribution",
        ("altered source versions must be plainly marked",),
    ),
    Template(
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in"
        " source code form or as a compiled binary for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or"
        " authors of this software dedicate any and all copyright interest in the software to the public domain",
        ("free and unencumbered software",),
    ),
    Template(
        "bsl-1.0",
        "boost software license version 1 0 permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying"
        " documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the"
        " software and to permit third parties to whom the software is furnished to do so",
        ("boost software license",),
    ),
    Template(
        "apache-2.0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"
        " http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is"
        " basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under"
        " the license",
        ("apache license version 2 0",),
    ),
    Template("gpl", _GNU.format(it="this program", name="general public license", version="3"), ("gnu general public license",)),
    Template("lgpl", _GNU.format(it="this library", name="lesser general public license", version="2 1"), ("gnu lesser general public license",)),
    Template("agpl", _GNU.format(it="this program", name="affero general public license", version="3"), ("gnu affero general public license",)),
    Template(
        "mpl-2.0",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at https"
        " mozilla org mpl 2 0",
        ("mozilla public license",),
    ),
    Template(
        "epl-2.0",
        "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
        ("eclipse public license",),
    ),
    Template("mit", "released under the mit license", ("mit license",)),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    Template("gpl", "this work is licensed under the gnu general public license version 3", ("gnu general public license",)),
    Template("lgpl", "licensed under the gnu lesser general public license", ("gnu lesser general public license",)),
    Template("agpl", "licensed under the gnu affero general public license", ("gnu affero general public license",)),
    Template("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template("cc-by-nd", "licensed under cc by nd 4 0", ("cc by nd",)),
    Template("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    Template("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike",)),
    Template("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial",)),
    Template("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright",)),
]
#: Words of a template that are looked up in a file that has them, those with the highest IDF, and how many of
#: them must meet at one relative position.
LOOKED_UP, MEET = 8, 2
#: Words by which a key phrase, and what is scored, may stand off that position.
DRIFT = 12
#: Share of a template's IDF that must stand there.
LEAST_SHARE = 0.3


def split(text: str) -> list[bytes]:
    return text.encode().split()


def vocabulary() -> set[bytes]:
    return {w for text in [*PHRASES, *(t.text for t in TEMPLATES)] for w in split(text)}


def document_frequencies(docs: DataFrame, text: str = "text") -> dict[bytes, int]:
    """In how many rows of `docs` each template word stands, and the rows (for b""); counted over all rows and
    whole texts.

    The result has an entry for each word of the templates, whatever the size of `docs`.
    """
    known = vocabulary()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = Counter(), 0
        for batch in batches:
            for (texts,) in text_chunks(batch):
                rows += len(texts)
                for t in texts:
                    total.update(known.intersection(alnum_words(t)))
        yield pa.RecordBatch.from_pydict({"word": [*[w.decode() for w in total], ""], "n": pa.array([*total.values(), rows], pa.int64())})

    counted = bounded_batches(docs).select(F.col(text).alias("text")).mapInArrow(lean(count), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {r.word.encode(): r.n for r in counted.collect()}


class Index:
    """Postings of the templates' words, and their IDF."""

    def __init__(self, frequency: dict[bytes, int]):
        rows = frequency.get(b"", 0)
        self.idf = {w: math.log((1 + rows) / (1 + frequency.get(w, 0))) + 1 for w in vocabulary()}
        self.rank = {w: (frequency.get(w, 0), w) for w in self.idf}
        self.templates = [(t.label, split(t.text), [split(k) for k in t.keys]) for t in TEMPLATES]
        self.places: list[dict[bytes, list[int]]] = []
        for _, words, _ in self.templates:
            self.places.append(defaultdict(list))
            for j, w in enumerate(words):
                self.places[-1][w].append(j)
        #: each template's words, the highest IDF first
        self.rarest = [sorted(p, key=self.rank.__getitem__) for p in self.places]
        self.weight = [sum(self.idf[w] for w in words) for _, words, _ in self.templates]
        self.mandatory = [{w for k in keys for w in k} for _, _, keys in self.templates]
        self.phrases = [(label, split(p)) for p, label in PHRASES.items()]
        #: the templates and phrases, by their rarest mandatory word, without which a file has none of them
        self.needed: dict[bytes, list[int]] = defaultdict(list)
        for number, words in enumerate([*self.mandatory, *(set(p) for _, p in self.phrases)]):
            self.needed[min(words, key=self.rank.__getitem__)].append(number)

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, str]], dict[str, float]]:
        """Places of base phrases, and for each label that holds the share of its template that stands there."""
        own = set(words)
        possible = [n for w in self.needed.keys() & own for n in self.needed[w]]
        if not possible:
            return [], {}
        at: dict[bytes, list[int]] = defaultdict(list)
        for i, w in enumerate(words):
            if w in self.idf:
                at[w].append(i)
        places, shares = [], {}
        for n in possible:
            if n >= len(self.templates):
                label, phrase = self.phrases[n - len(self.templates)]
                places += [(p, label) for p in self._meeting(at, phrase)]
            elif self.mandatory[n] <= own:
                label = self.templates[n][0]
                share = max((self._share(words, at, n, p) for p in self._candidates(at, n)), default=0.0)
                if share >= LEAST_SHARE:
                    shares[label] = max(share, shares.get(label, 0.0))
        return sorted(places), shares

    @staticmethod
    def _meeting(at: dict[bytes, list[int]], phrase: list[bytes]) -> set[int]:
        """Relative positions at which all words of a phrase meet, that is, its places."""
        order = sorted(range(len(phrase)), key=lambda j: len(at.get(phrase[j], ())))
        out: set[int] | None = None
        for j in order:
            here = {i - j for i in at.get(phrase[j], ())}
            out = here if out is None else out & here
            if not out:
                break
        return out or set()

    def _candidates(self, at: dict[bytes, list[int]], n: int) -> list[int]:
        """Relative positions at which MEET of the looked-up words meet."""
        looked_up = [w for w in self.rarest[n] if w in at][:LOOKED_UP]
        votes = Counter()
        for w in looked_up:
            votes.update({i - j for i in at[w] for j in self.places[n][w]})
        return [p for p, c in votes.items() if c >= MEET]

    def _share(self, words: list[bytes], at: dict[bytes, list[int]], n: int, p: int) -> float:
        """The share of template n around relative position p; 0 if a key phrase isn't there."""
        _, template, keys = self.templates[n]
        for key in keys:
            own = [j for j in self.places[n][key[0]] if template[j : j + len(key)] == key]
            if not any(abs(i - j - p) <= DRIFT for i in at[key[0]] if words[i : i + len(key)] == key for j in own):
                return 0.0
        first = p - DRIFT
        here = words[max(0, first) : max(0, p + len(template) + DRIFT)]
        offset = max(0, first)
        place: dict[bytes, list[int]] = defaultdict(list)
        for i, w in enumerate(here):
            place[w].append(offset + i)
        found = sum(self.idf[w] for j, w in enumerate(template) if any(abs(i - j - p) <= DRIFT for i in place.get(w, ())))
        return min(1.0, found / self.weight[n])


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
_TYPES = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
_ARROW = pa.schema([(c, _TYPES[t]) for c, t in (x.split() for x in SCHEMA.split(", "))])


def scan(docs: DataFrame, frequency: dict[bytes, int] | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of `docs`: counts and places of base phrases, labels, and a score.

    score is the largest share of a template that was found, at least 0.5 where a base phrase stands,
    and 0 without any label, to 6 digits.  A null or empty text has no words and no labels; a null
    doc_id is kept; repeated rows stay; an empty table stays empty; other columns are ignored.  Texts
    may have any length: a worker takes memory in proportion to the longest.
    """
    index = Index(document_frequencies(docs, text) if frequency is None else frequency)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in text_chunks(batch):
                rows = []
                for i, t in zip(ids, texts):
                    words = alnum_words(t)
                    places, shares = index.scan(words)
                    base = {label for _, label in places}
                    score = round(max([0.5 * bool(base), *shares.values()]), 6)
                    first, last = (places[0][0], places[-1][0]) if places else (None, None)
                    rows.append((i, len(words), len(places), first, last, ",".join(sorted(base)), ",".join(sorted(base | set(shares))), score))
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _ARROW)], schema=_ARROW)

    return bounded_batches(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(lean(run), SCHEMA)
