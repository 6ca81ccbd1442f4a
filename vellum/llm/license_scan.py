"""License scans by diagonal voting.

Method. Words are runs of ASCII letters and digits (lower-cased) and of non-ASCII bytes. Hashes of
all rolling k-grams of every text meet the positions of the same k-grams in license templates. A
hit votes for its diagonal, text position minus template position. Neighbouring diagonals (an
inserted or lost word shifts a match to the next one) are merged. A merged span is verified where
the text is read: its words are compared with the template's along its diagonals, and the equal
ones must reach `min_cover` of the template and k + 3 words (or all of a shorter template). The
distinguishing words (MARKS) of the span and of the template must be the same. The span may be at
most `max_stretch` times as long as the part of the template that it matches. Of overlapping spans
those with the most equal words count.

Besides the templates, fixed phrases are found word by word; their labels are always reported.

Scale. Templates travel to the texts in blocks of at most max_template_grams k-grams (one template
at least), each of which takes a scan of its own. Texts never move; only a row of results for each
text does, and only if there are several blocks.

Defined results. Null text counts as empty: no words, no labels, score 0. Every row has a result of
its own, also repeated rows and null keys. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vellum.llm import common as C

K = 3

# Base phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Wording of public license notices, by label.
TEMPLATES = [
    ("agpl-3", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("agpl-3", "licensed under the GNU Affero General Public License, version 3"),
    ("agpl-3", "SPDX-License-Identifier: AGPL-3.0"),
    ("apache-2", "licensed under the Apache License, Version 2.0"),
    ("apache-2", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache-2", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("apache-2", "SPDX-License-Identifier: Apache-2.0"),
    ("boost", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd", "SPDX-License-Identifier: BSD-3-Clause"),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by", "licensed under CC BY 4.0"),
    ("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nc", "licensed under CC BY-NC 4.0"),
    ("cc-by-nc-nd", "licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
    ("cc-by-nc-nd", "licensed under CC BY-NC-ND 4.0"),
    ("cc-by-nc-sa", "licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    ("cc-by-nc-sa", "licensed under CC BY-NC-SA 4.0"),
    ("cc-by-nd", "licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    ("cc-by-nd", "licensed under CC BY-ND 4.0"),
    ("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-sa", "licensed under CC BY-SA 4.0"),
    ("cc0", "dedicated to the public domain under the Creative Commons CC0 1.0 Universal public domain dedication"),
    ("epl-2", "made available under the terms of the Eclipse Public License 2.0"),
    ("gpl-2", "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or any later version"),
    ("gpl-2", "licensed under the GNU General Public License, version 2"),
    ("gpl-2", "SPDX-License-Identifier: GPL-2.0"),
    ("gpl-3", "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version"),
    ("gpl-3", "licensed under the GNU General Public License, version 3"),
    ("gpl-3", "SPDX-License-Identifier: GPL-3.0"),
    ("isc", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("lgpl", "licensed under the GNU Lesser General Public License"),
    ("lgpl", "under the terms of the GNU Library General Public License as published by the Free Software Foundation"),
    ("mit", "released under the MIT License"),
    ("mit", "licensed under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("mit", "SPDX-License-Identifier: MIT"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("mpl-2", "SPDX-License-Identifier: MPL-2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software"),
]

# Words and word pairs that tell licenses apart.
MARKS = ["mit", "apache", "agpl", "gpl", "mpl", "bsd", "lesser", "library", "affero", "mozilla", "eclipse", "organization", "attribution", "noncommercial", "sharealike", "noderivatives", "noderivs", "by nc", "by nd", "by sa", "nc nd", "nc sa", "cc0", "version 1", "version 2", "version 3", "v 1", "v 2", "v 3", "gpl 2", "gpl 3"]


def hashed(texts: list[str], k: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Word hashes and k-gram hashes of each text."""
    words, grams = [], []
    for _, _, buf, offsets in C.slices(pa.array(texts, pa.string())):
        low = C.LOWER[buf]
        starts, ends, first = C.words(low, offsets, C.NOT_ALNUM)
        h = C.span_hash(C.prefix_hash(low), starts, ends)
        g, counts = C.grams(h, first, k)
        words += np.split(h, first[1:-1])
        grams += np.split(g, np.cumsum(counts)[:-1])
    return words, grams


class Templates:
    """A block of templates; gram s stands at (item[at[s]:at[s + 1]], offset[...])."""

    def __init__(self, templates: list[tuple[str, str]], k: int):
        self.k, self.labels = k, [label for label, _ in templates]
        self.words, grams = hashed([t for _, t in templates], k)
        marks, _ = hashed(MARKS, 1)
        self.marks = [(m[0], m[1] if len(m) > 1 else None) for m in marks]
        self.marked = [self.marks_of(w) for w in self.words]
        every = np.concatenate([*grams, np.zeros(0, np.uint64)])
        order = np.argsort(every, kind="stable")
        self.item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])[order]
        self.offset = np.concatenate([np.arange(len(g)) for g in grams] + [np.zeros(0, np.int64)])[order].astype(np.int64)
        self.grams, at = np.unique(every[order], return_index=True)
        self.at = np.append(at, len(every))

    def marks_of(self, w: np.ndarray) -> frozenset[int]:
        out = set()
        for i, (a, b) in enumerate(self.marks):
            at = np.flatnonzero(w == a)
            if len(at) and (b is None or (w[at[at + 1 < len(w)] + 1] == b).any()):
                out.add(i)
        return frozenset(out)

    def spans(self, h: np.ndarray, first: np.ndarray, min_cover: float, max_stretch: float, gap: int) -> list[list[tuple[int, int, int, int, str]]]:
        """For each row the verified (from, to, equal words, template words, label)."""
        out: list[list[tuple[int, int, int, int, str]]] = [[] for _ in range(len(first) - 1)]
        g, counts = C.grams(h, first, self.k)
        if not len(g) or not len(self.grams):
            return out
        s = np.searchsorted(self.grams, g)
        s[s == len(self.grams)] = 0
        near = np.flatnonzero(self.grams[s] == g)
        s = s[near]
        begin = np.concatenate(([0], np.cumsum(counts)))
        row = np.searchsorted(begin, near, "right") - 1
        place = near - begin[row] + first[row]
        many = self.at[s + 1] - self.at[s]
        src = np.repeat(self.at[s], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        row, place, tpl, offset = np.repeat(row, many), np.repeat(place, many), self.item[src], self.offset[src]
        diagonal = place - offset
        order = np.lexsort((place, diagonal, tpl, row))
        row, place, tpl, offset, diagonal = row[order], place[order], tpl[order], offset[order], diagonal[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (tpl[1:] != tpl[:-1]) | (diagonal[1:] - diagonal[:-1] > gap)
        cut = np.append(np.flatnonzero(new), len(row))
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            words, r = self.words[tpl[a]], int(row[a])
            lo, hi = int(place[a:b].min()), int(place[a:b].max()) + self.k
            reach = int(offset[a:b].max() - offset[a:b].min()) + self.k
            if hi - lo > max_stretch * reach or self.marks_of(h[lo:hi]) != self.marked[tpl[a]]:
                continue
            equal = np.zeros(len(words), bool)
            for d in np.unique(diagonal[a:b]):
                x, y = max(lo, int(d)), min(hi, int(d) + len(words))
                equal[x - d : y - d] |= h[x:y] == words[x - d : y - d]
            n = int(equal.sum())
            if n >= max(min_cover * len(words), min(self.k + 3, len(words))):
                out[r].append((lo - int(first[r]), hi - int(first[r]), n, len(words), self.labels[tpl[a]]))
        return out


def best(spans: list[tuple[int, int, int, int, str]]) -> list[tuple[int, int, int, int, str]]:
    """The spans that no overlapping one with more equal words beats."""
    out, group, end = [], [], 0
    for x in [*sorted(spans), None]:
        if group and (x is None or x[0] >= end):
            out += [y for y in group if not any(z[2] > y[2] and z[0] < y[1] and y[0] < z[1] for z in group)]
            group, end = [], 0
        if x is not None:
            group.append(x)
            end = max(end, x[1])
    return out


def rows_of(docs: DataFrame, key: str, text: str, block: Templates, min_cover: float, max_stretch: float, gap: int) -> DataFrame:
    """uid, key, base columns and the verified spans for each text."""
    phrases, _ = hashed(list(PHRASES), 1)
    labels = list(PHRASES.values())
    schema = StructType().add("uid", "long").add("key", docs.schema[key].dataType)
    for c in ("n_words", "n_base", "first_word", "last_word"):
        schema = schema.add(c, "long")
    schema = StructType([*schema.add("base_labels", "string").fields, *StructType.fromDDL("spans array<struct<lo:long,hi:long,equal:long,size:long,label:string>>").fields])
    kind = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64()), ("equal", pa.int64()), ("size", pa.int64()), ("label", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col, uid = C.text_column(batch, "t"), batch.column(0).to_numpy()
            for lo, hi, buf, offsets in C.slices(col):
                low = C.LOWER[buf]
                starts, ends, first = C.words(low, offsets, C.NOT_ALNUM)
                h = C.span_hash(C.prefix_hash(low), starts, ends)
                n = hi - lo
                n_base, least, most = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
                got: list[set[str]] = [set() for _ in range(n)]
                for phrase, label in zip(phrases, labels, strict=True):
                    at = np.flatnonzero(h == phrase[0])
                    at = at[at + len(phrase) <= len(h)]
                    for j in range(1, len(phrase)):
                        at = at[h[at + j] == phrase[j]]
                    row = np.searchsorted(first, at, "right") - 1
                    inside = at + len(phrase) <= first[row + 1] if len(at) else np.zeros(0, bool)
                    at, row = at[inside], row[inside]
                    np.add.at(n_base, row, 1)
                    np.minimum.at(least, row, at - first[row])
                    np.maximum.at(most, row, at - first[row])
                    for r in set(row.tolist()):
                        got[r].add(label)
                none = n_base == 0
                spans = [[dict(zip(("lo", "hi", "equal", "size", "label"), x, strict=True)) for x in best(xs)] for xs in block.spans(h, first, min_cover, max_stretch, gap)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(uid[lo:hi]),
                        batch.column(1).slice(lo, n),
                        pa.array(np.diff(first)),
                        pa.array(n_base),
                        pa.array(least, mask=none),
                        pa.array(most, mask=none),
                        pa.array([",".join(sorted(x)) for x in got], pa.string()),
                        pa.array(spans, kind),
                    ],
                    schema.names,
                )

    source = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"))
    return source.mapInArrow(run, schema)


def blocks(templates: list[tuple[str, str]], k: int, limit: int) -> list[list[tuple[str, str]]]:
    out, size = [[]], 0
    for x, g in zip(templates, hashed([t for _, t in templates], k)[1], strict=True):
        if out[-1] and size + len(g) > limit:
            out.append([])
            size = 0
        out[-1].append(x)
        size += len(g)
    return out


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: list[tuple[str, str]] | None = None, k: int = K, min_cover: float = 0.6, max_stretch: float = 1.5, gap: int = 2, max_template_grams: int = 200_000) -> DataFrame:
    """key, n_words, n_base, first_word, last_word, base_labels, labels, score for each row of docs."""
    out = None
    for some in blocks(TEMPLATES if templates is None else templates, k, max_template_grams):
        rows = rows_of(docs, key, text, Templates(some, k), min_cover, max_stretch, gap)
        if out is None:
            out, passes = rows, 1
        else:
            out, passes = out.unionByName(rows), passes + 1
    if passes > 1:
        carried = [F.max(c).alias(c) for c in out.columns[1:-1]]
        out = out.groupBy("uid").agg(*carried, F.flatten(F.collect_list("spans")).alias("spans"))
        beaten = lambda y: F.exists("spans", lambda z: (z["equal"] > y["equal"]) & (z["lo"] < y["hi"]) & (y["lo"] < z["hi"]))
        out = out.withColumn("spans", F.filter("spans", lambda y: ~beaten(y)))
    base = F.filter(F.split("base_labels", ","), lambda x: x != "")
    more = F.transform("spans", lambda x: x["label"])
    cover = F.array_max(F.transform("spans", lambda x: x["equal"] / x["size"]))
    return out.select(
        F.col("key").alias(key),
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        "base_labels",
        F.array_join(F.array_sort(F.array_union(base, more)), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce(cover, F.lit(0.0))).alias("score"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(C.tables(sf_dir, "documents")).select("doc_id", "text"))
