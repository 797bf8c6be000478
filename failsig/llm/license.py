"""Operator 1: license scans, an exact set-similarity join of text blocks with templates."""

from __future__ import annotations

from collections.abc import Mapping
from fractions import Fraction
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed, ship, utf8

# Phrases and the label of each.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

# Notices as their licenses word them, and the label the method adds for each.
TEMPLATES = {
    "Released under the MIT License": "mit",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
    "software and associated documentation files": "mit",
    "Licensed under the Apache License, Version 2.0": "apache",
    "This work is licensed under the GNU General Public License, version 3": "gnu-gpl",
    "This program is free software: you can redistribute it and/or modify it under the terms of "
    "the GNU General Public License": "gnu-gpl",
    "This library is free software; you can redistribute it and/or modify it under the terms of "
    "the GNU Lesser General Public License": "gnu-lgpl",
    "Licensed under CC BY-NC 4.0": "cc-by-nc",
    "This work is licensed under a Creative Commons Attribution 4.0 International License": "cc",
    "Redistribution and use in source and binary forms, with or without modification, are "
    "permitted provided that the following conditions are met": "bsd",
    "This Source Code Form is subject to the terms of the Mozilla Public License": "mpl",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
    "without fee is hereby granted": "isc",
    "This is free and unencumbered software released into the public domain": "unlicense",
    "All rights reserved": "proprietary",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
    'software and associated documentation files (the "Software"), to deal in the Software '
    "without restriction, including without limitation the rights to use, copy, modify, merge, "
    "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons "
    "to whom the Software is furnished to do so, subject to the following conditions: The above "
    "copyright notice and this permission notice shall be included in all copies or substantial "
    'portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, '
    "EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS "
    "FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT "
    "HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
    "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE "
    "USE OR OTHER DEALINGS IN THE SOFTWARE.": "mit",
    "Redistribution and use in source and binary forms, with or without modification, are "
    "permitted provided that the following conditions are met: 1. Redistributions of source code "
    "must retain the above copyright notice, this list of conditions and the following "
    "disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
    "this list of conditions and the following disclaimer in the documentation and/or other "
    "materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS "
    'AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED '
    "TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED.": "bsd",
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file '
    "except in compliance with the License. You may obtain a copy of the License at "
    "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
    'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT '
    "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the "
    "specific language governing permissions and limitations under the License.": "apache",
    "This program is free software: you can redistribute it and/or modify it under the terms of "
    "the GNU General Public License as published by the Free Software Foundation, either version 3 "
    "of the License, or (at your option) any later version. This program is distributed in the "
    "hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
    "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for "
    "more details.": "gnu-gpl",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a "
    "copy of the MPL was not distributed with this file, You can obtain one at "
    "https://mozilla.org/MPL/2.0/.": "mpl",
}

THRESHOLD = Fraction(4, 5)  # of a template's distinct words that a block must hold
BLOCK = 64  # words of the shortest blocks; blocks overlap by half
BROADCAST = 32 << 20  # bytes of template rows up to which they are broadcast

_CLEAN = bytes(
    c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32
    for c in range(256)
)


def tokens(text: bytes) -> list[bytes]:
    """A-Z lowered; words are runs of digits, letters and non-ASCII characters."""
    return text.translate(_CLEAN).split()


def _places(found: list[bytes], text: bytes, phrases) -> list[tuple[int, str]]:
    out = []
    for phrase, label in phrases:
        if phrase[0] not in text:
            continue
        at = -1
        try:
            while True:
                at = found.index(phrase[0], at + 1)
                if tuple(found[at : at + len(phrase)]) == phrase:
                    out.append((at, label))
        except ValueError:
            pass
    return out


def _token_counts(docs: DataFrame, wanted: frozenset[bytes]) -> dict[bytes, int]:
    """In how many documents each template word occurs; at most as many rows as there are words."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.array(
            [[w.decode() for w in wanted.intersection(tokens(t))] for t in texts.to_pylist()],
            pa.list_(pa.string()),
        )

    found = docs.select(F.explode(F.arrow_udf(run, "array<string>")(utf8())).alias("token"))
    return {r["token"].encode(): r["count"] for r in found.groupBy("token").count().collect()}


def scan(
    docs: DataFrame,
    templates: Mapping[str, str] = TEMPLATES,
    phrases: Mapping[str, str] = PHRASES,
    threshold: Fraction = THRESHOLD,
    block: int = BLOCK,
) -> DataFrame:
    """``doc_id``, ``n_words``, ``places`` (start, label of each phrase) and ``found`` of each row.

    ``found`` lists the (size, block, label, containment) of every block that holds at least
    ``threshold`` of a template's distinct words; block b of a size starts at word b * size / 2, and
    containment is the share of the template's words. A template is sought in blocks of the
    smallest size, ``block`` doubled as often as needed, whose half takes all its words, so a text
    of its words in a row always lies within one. Template words are ordered by how many
    documents hold them, rare first; words of no template can't count towards an overlap and
    drop out of both sides. A template that needs an overlap of o must share one of its first
    size - o + 1 words with such a block, so those meet the block's own first words in a join;
    the length filter drops blocks with fewer than o words, the positional filter those whose
    remaining words can't reach o, and the rest are verified in full.

    Texts that are null or empty have no words, no places and nothing found. Templates are a
    parameter; their rows are broadcast while they take at most ``BROADCAST`` bytes and shuffled
    beyond. Templates without words match nothing. Rows that come more than once stay as often.
    A long text is many small rows: its places travel on one of them.
    """
    spark = docs.sparkSession
    sets = []
    for t, label in templates.items():
        found = tokens(t.encode())
        if found:
            size = block
            while size // 2 < len(found):
                size *= 2
            sets.append((label, frozenset(found), size))
    wanted = frozenset().union(*(s for _, s, _ in sets))
    counts = _token_counts(docs, wanted)
    rank = {w: k for k, w in enumerate(sorted(wanted, key=lambda w: (counts.get(w, 0), w)))}
    rules, weight = [], 0
    # by size of block: all words of its templates, those that a template may be met by, and the
    # smallest overlap that any of them needs
    by_size: dict[int, tuple[set[int], set[int], list[int]]] = {}
    for label, members, size in sets:
        need = ceil(threshold * len(members))
        order = sorted(rank[w] for w in members)
        every, firsts, least = by_size.setdefault(size, (set(), set(), [need]))
        every.update(order)
        least[0] = min(least[0], need)
        for place, token in enumerate(order[: len(order) - need + 1]):
            rules.append((size, token, place, label, need, order))
            firsts.add(token)
            weight += 64 + 4 * len(order)
    exact = [(tuple(tokens(p.encode())), label) for p, label in phrases.items()]

    def run(texts: pa.Array) -> pa.Array:
        n_words, blocks = [], []
        for t in texts.to_pylist():
            found = tokens(t)
            n_words.append(len(found))
            places = [
                {"start": at, "label": label}
                for at, label in _places(found, t.translate(_CLEAN), exact)
            ]
            out = [{"size": 0, "block": -1, "tokens": [], "first": 0, "places": places}]
            hits = [(k, rank[w]) for k, w in enumerate(found) if w in rank]
            for size, (every, firsts, (least,)) in by_size.items():
                if not any(r in firsts for _, r in hits):
                    continue
                mine: dict[int, set[int]] = {}
                for k, r in hits:
                    if r in every:
                        b = k // (size // 2)
                        mine.setdefault(b, set()).add(r)
                        if b:
                            mine.setdefault(b - 1, set()).add(r)
                out += [
                    {
                        "size": size,
                        "block": b,
                        "tokens": sorted(s),
                        "first": len(s) - least + 1,
                        "places": None,
                    }
                    for b, s in sorted(mine.items())
                    if len(s) >= least and not firsts.isdisjoint(s)
                ]
            blocks.append(out)
        return pa.StructArray.from_arrays(
            [pa.array(n_words, pa.int64()), pa.array(blocks, pa.list_(block_type))],
            ["n_words", "blocks"],
        )

    block_type = pa.struct(
        [
            ("size", pa.int32()),
            ("block", pa.int64()),
            ("tokens", pa.list_(pa.int32())),
            ("first", pa.int32()),
            ("places", pa.list_(pa.struct([("start", pa.int64()), ("label", pa.string())]))),
        ]
    )
    kind = (
        "n_words long, blocks array<struct<size: int, block: long, tokens: array<int>, "
        "first: int, places: array<struct<start: long, label: string>>>>"
    )
    rows = packed(docs).select(
        F.monotonically_increasing_id().alias("rid"),
        "row.doc_id",
        F.arrow_udf(run, kind)(utf8("row.text")).alias("s"),
    )
    rule = spark.createDataFrame(
        rules or [(-1, -1, 0, "", 1, [])],
        "of int, token int, place int, label string, need int, members array<int>",
    )
    if weight <= BROADCAST:
        rule = F.broadcast(rule)
    # the first element of each text's list carries its places and no words
    block_first = rows.select("rid", "doc_id", "s.n_words", F.explode("s.blocks").alias("b")).select(
        "rid",
        "doc_id",
        "n_words",
        "b",
        F.posexplode_outer(F.slice("b.tokens", F.lit(1), F.col("b.first"))).alias("at", "first"),
    )
    size = F.size("b.tokens")
    overlap = F.size(F.array_intersect("b.tokens", "members"))
    reach = (
        1
        + F.least(size - F.col("at") - 1, F.size("members") - F.col("place") - 1)
        + F.least("at", "place")
    )
    pairs = block_first.join(
        rule,
        (F.col("first") == F.col("token"))
        & (F.col("b.size") == F.col("of"))
        & (size >= F.col("need"))
        & (reach >= F.col("need"))
        & (overlap >= F.col("need")),
        "left",
    )
    match = F.when(
        F.col("label").isNotNull(),
        F.struct(
            F.col("b.size").alias("size"),
            F.col("b.block").alias("block"),
            "label",
            (overlap / F.size("members")).alias("containment"),
        ),
    )
    return pairs.groupBy("rid").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_words").alias("n_words"),
        F.first("b.places", ignorenulls=True).alias("places"),
        F.array_sort(F.collect_set(match)).alias("found"),
    )


ship(__name__)
