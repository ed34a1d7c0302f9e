"""License scans: base phrases, and licences found by a positional rare-word index."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import by_row, flat, pieces, spans, word_hashes

#: fixed values: base phrases and their labels
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: fixed values: label, mandatory key phrases, and the text of a licence or, where that
#: is long, of the notice that puts a file under it
TEMPLATES = [
    ("mit", ["mit license"], "released under the mit license"),
    ("mit", ["granted free of charge"], """permission is hereby granted free of charge to any person obtaining a copy of
        this software and associated documentation files the software to deal in the software without restriction"""),
    ("mit", ["granted free of charge", "without warranty of any kind"], """permission is hereby granted free of charge to any person
        obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including
        without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit
        persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission
        notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any
        kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and
        noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an
        action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"""),
    ("apache-2", ["apache license version 2"], "licensed under the apache license version 2 0"),
    ("apache-2", ["except in compliance with the license"], """you may not use this file except in compliance with the license you may obtain a copy of
        the license at"""),
    ("apache-2", ["apache license version 2 0", "limitations under the license"], """licensed under the apache license version 2 0 the license you may not use
        this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless
        required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without
        warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and
        limitations under the license"""),
    ("cc-by-nc", ["cc by nc"], "licensed under cc by nc 4 0"),
    ("cc-by", ["creative commons attribution 4 0"], "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", ["creative commons attribution noncommercial"], "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", ["creative commons attribution sharealike"], "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("gpl-3", ["gnu general public license version 3"], "this work is licensed under the gnu general public license version 3"),
    ("gpl", ["gnu general public license"], "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", ["gnu general public license", "free software foundation"], """this program is free software you can redistribute it and or modify it under the
        terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any
        later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of
        merchantability or fitness for a particular purpose see the gnu general public license for more details"""),
    ("lgpl", ["gnu lesser general public license"], "under the terms of the gnu lesser general public license"),
    ("agpl-3", ["gnu affero general public license"], "licensed under the gnu affero general public license version 3"),
    ("bsd", ["source and binary forms"], "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-2", ["source and binary forms", "binary form must reproduce"], """redistribution and use in source and binary forms with or without modification are
        permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list
        of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of
        conditions and the following disclaimer in the documentation and or other materials provided with the distribution"""),
    ("bsd-3", ["endorse or promote products"], """neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
        products derived from this software without specific prior written permission"""),
    ("mpl-2", ["mozilla public license"], """this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not
        distributed with this file you can obtain one at"""),
    ("mpl-2", ["mozilla public license"], "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", ["with or without fee"], """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"""),
    ("isc", ["with or without fee", "in all copies"], """permission to use copy modify and or distribute this software for any purpose with or without fee is
        hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and
        the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no
        event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of
        use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or
        performance of this software"""),
    ("unlicense", ["unencumbered software"], "this is free and unencumbered software released into the public domain"),
    ("zlib", ["any express or implied warranty"], """this software is provided as is without any express or implied warranty in no event will the authors be held
        liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including
        commercial applications and to alter it and redistribute it freely"""),
]
#: share of a template's words that must stand about where the template has them
MATCH = 0.75

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_BREAKS = np.ones(256, bool)
_BREAKS[0x30:0x3A] = _BREAKS[0x61:0x7B] = _BREAKS[0x80:] = False


def _tokens(column: pa.Array):
    data, offsets = flat(column)
    data = _LOWER[data]
    starts, ends, first = spans(data, offsets, _BREAKS)
    return word_hashes(data, starts, ends), first


def _hashes(phrase: str) -> np.ndarray:
    return _tokens(pa.array([phrase]))[0]


@dataclass
class LicenseIndex:
    """Positional postings of the licence words: ``words`` (sorted hashes), their
    ``idf`` over the corpus, and for each template the word at each place and its key
    phrases. Templates' rarest words are posted by word: from ``edge`` on the
    ``template`` and how many ``times`` it has the word there; ``least`` of them
    stand in each file that holds the template."""

    words: np.ndarray
    idf: np.ndarray
    texts: list[np.ndarray]
    edge: np.ndarray
    template: np.ndarray
    times: np.ndarray
    least: np.ndarray
    keys: list[list[np.ndarray]]


def slack(words: int) -> int:
    """How far a word may stand from its place in a template of so many words."""
    return 2 + words // 20


def vocabulary() -> np.ndarray:
    return np.unique(np.concatenate([_hashes(t) for *_, t in TEMPLATES]))


def document_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[int, dict[int, int]]:
    """How many texts there are, and in how many each licence word stands; the
    vocabulary is fixed."""
    words = vocabulary()

    def run(batches):
        total, texts = np.zeros(len(words), np.int64), 0
        for b in batches:
            texts += b.num_rows
            for i, n in pieces(b.column(0)):
                h, first = _tokens(b.column(0).slice(i, n))
                at, ok = _look_up(words, h)
                total += np.bincount(np.unique(at[ok] * n + by_row(first)[ok]) // n, minlength=len(words))
        out = [pa.array([*words.view(np.int64).tolist(), None], pa.int64()), pa.array(np.r_[total, texts])]
        yield pa.RecordBatch.from_arrays(out, ["word", "n"])

    rows = docs.select(text_col).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {None if r.word is None else r.word & (2**64 - 1): r.n for r in rows}
    return counts.pop(None, 0), counts


def _look_up(sorted_words: np.ndarray, h: np.ndarray):
    """Index in ``sorted_words`` of each hash, and whether it is there; a table
    over the top bits spares most words the search."""
    some = np.zeros(1 << 16, bool)
    some[(sorted_words >> np.uint64(48)).astype(np.int64)] = True
    ok = some[(h >> np.uint64(48)).astype(np.int64)]
    at = np.zeros(len(h), np.int64)
    hit = np.flatnonzero(ok)
    found = np.minimum(np.searchsorted(sorted_words, h[hit]), len(sorted_words) - 1)
    at[hit] = found
    ok[hit] = sorted_words[found] == h[hit]
    return at, ok


def build_index(texts: int, frequency: dict[int, int]) -> LicenseIndex:
    """Index all words of all templates, with idf from ``document_frequencies``."""
    words = vocabulary()
    df = np.array([frequency.get(int(x), 0) for x in words], float)
    places = [np.searchsorted(words, _hashes(t)) for *_, t in TEMPLATES]
    idf = np.log((texts + 1) / (df + 1))
    posted, least = [], []
    for k, text in enumerate(places):
        rare = text[np.argsort(-idf[text], kind="stable")][: 2 * _miss(text) + 2]
        word, times = np.unique(rare, return_counts=True)
        posted.append(np.stack([word, np.full(len(word), k), times]))
        least.append(len(rare) - _miss(text))
    word, template, times = np.concatenate(posted, axis=1)[:, np.argsort(np.concatenate(posted, axis=1)[0], kind="stable")]
    edge = np.searchsorted(word, np.arange(len(words) + 1))
    return LicenseIndex(words, idf, places, edge, template, times, np.array(least), [[_hashes(k) for k in keys] for _, keys, _ in TEMPLATES])


def _miss(text: np.ndarray) -> int:
    """Words of a template that a file may lack."""
    return len(text) - int(np.ceil(MATCH * len(text)))


def _phrase_places(h: np.ndarray, row: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    n, k = len(h), len(phrase)
    if n < k:
        return np.zeros(0, np.int64)
    at = np.flatnonzero(h[: n - k + 1] == phrase[0])
    for j in range(1, k):
        at = at[(h[at + j] == phrase[j]) & (row[at + j] == row[at])]
    return at


def _starts(text: np.ndarray, word: np.ndarray, place: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Where in a file (words and places of its licence words) a template may start,
    on a grid of its slack.

    The file's highest-idf words of the template vote, each for the starts that put
    it within the slack of its place in the template. So many words are looked up
    that a start of share MATCH can't miss the votes asked for.
    """
    step, miss = slack(len(text)), _miss(text)
    held = np.isin(text, word)
    spots = np.flatnonzero(held)
    spots = spots[np.argsort(-idf[text[spots]], kind="stable")][: 2 * miss + 2]
    least = len(spots) - (miss - int((~held).sum()))
    spots = spots[np.argsort(text[spots], kind="stable")]
    lo, hi = np.searchsorted(text[spots], word), np.searchsorted(text[spots], word, "right")
    which = np.repeat(np.arange(len(word)), hi - lo)
    j = spots[np.arange(len(which)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)]
    start = place[which] - j
    up = -(-start // step)
    even = start % step == 0
    grid, j = np.r_[up - 1, up, up[even] + 1], np.r_[j, j, j[even]]
    votes = np.unique(grid * len(text) + j) // len(text)
    grid, count = np.unique(votes, return_counts=True)
    return grid[count >= least] * step


def _fit(own: np.ndarray, start: int, text: np.ndarray, keys: list[np.ndarray]) -> float:
    """Share of a template's words that stand within the slack of their place when it
    starts at ``start``; 0 where a key phrase is missing."""
    wide = slack(len(text))
    a = max(0, start - wide)
    part = own[a : max(0, start + len(text) + wide)]
    off = a - start + np.arange(len(part))[:, None] - np.arange(len(text))
    share = float(((part[:, None] == text) & (np.abs(off) <= wide)).any(axis=0).mean()) if len(part) else 0.0
    if share >= MATCH and all(len(_phrase_places(part, np.zeros(len(part), int), k)) for k in keys):
        return share
    return 0.0


def _template_hits(h: np.ndarray, first: np.ndarray, row: np.ndarray, index: LicenseIndex):
    """(row, template, share of words matched) of verified templates.

    Each file's licence words are looked up in the postings of the templates' rarest
    words. A file that holds MATCH of a template lacks few of these, so only
    templates of which it holds as many go on to be intersected by place.
    """
    at, ok = _look_up(index.words, h)
    spot = np.flatnonzero(ok)
    word, of = at[spot], row[spot]
    own_words = np.unique(of * len(index.words) + word)
    r, w = own_words // len(index.words), own_words % len(index.words)
    many = index.edge[w + 1] - index.edge[w]
    post = np.repeat(index.edge[w] - (np.cumsum(many) - many), many) + np.arange(many.sum())
    held = np.bincount(np.repeat(r, many) * len(index.texts) + index.template[post], index.times[post], (len(first) - 1) * len(index.texts))
    out = []
    for r, k in np.argwhere(held.reshape(-1, len(index.texts)) >= index.least).tolist():
        text, best = index.texts[k], 0.0
        lo, hi = np.searchsorted(of, [r, r + 1])
        own = h[first[r] : first[r + 1]]
        for s in _starts(text, word[lo:hi], spot[lo:hi] - first[r], index.idf).tolist():
            best = max(best, _fit(own, s, index.words[text], index.keys[k]))
            if best == 1:
                break
        if best:
            out.append((r, k, best))
    return out


def scan_licenses(docs: DataFrame, index: LicenseIndex | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_words, n_base, first_word, last_word, base_labels, labels, score)``.

    Base labels come from places where a base phrase's words stand in a row;
    the method adds the labels of verified templates. ``score`` is 1 with a base
    label, else the best template's share of matched words, else 0. Null and
    empty texts have no words, empty labels and null places. Very long texts are
    scanned whole; repeated rows each give theirs; other columns are not read;
    an empty table gives no rows. Templates and starts that match a file equally
    well all give their labels, sorted by name, and one score.
    """
    if index is None:
        index = build_index(*document_frequencies(docs, text_col))
    base = [(_hashes(p), label) for p, label in BASE.items()]
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            for i, n in pieces(b.column(1)):
                h, first = _tokens(b.column(1).slice(i, n))
                row = by_row(first)
                count, low, high = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
                labels, more, score = [set() for _ in range(n)], [set() for _ in range(n)], np.zeros(n)
                for phrase, label in base:
                    at = _phrase_places(h, row, phrase)
                    r, place = row[at], at - first[row[at]]
                    count += np.bincount(r, minlength=n)
                    np.minimum.at(low, r, place)
                    np.maximum.at(high, r, place)
                    for k in np.unique(r):
                        labels[k].add(label)
                for r, k, share in _template_hits(h, first, row, index):
                    more[r].add(TEMPLATES[k][0])
                    score[r] = max(score[r], share)
                none = count == 0
                score[~none] = 1.0
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(i, n), pa.array(np.diff(first)), pa.array(count), pa.array(low, mask=none), pa.array(high, mask=none),
                        pa.array([",".join(sorted(x)) for x in labels]), pa.array([",".join(sorted(x | y)) for x, y in zip(labels, more)]), pa.array(score),
                    ],
                    [id_col, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
                )

    schema = f"{id_col} {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return docs.select(id_col, text_col).mapInArrow(run, schema)
