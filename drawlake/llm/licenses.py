"""License scans: normalised passages against licence templates by the Dice coefficient over word bigrams.

A passage is a line of a text, the whole text, or a window of its words wherever it stands. The SQL has lines and whole
texts against the notices only; windows and whole licences add what these miss. Words are runs of a-z and 0-9 (with inner version dots) after
A-Z are lowered. A template is looked at only if its size allows the coefficient to reach the threshold:
2·min/(a+b) >= t bounds the sizes of both sides.
"""

from __future__ import annotations

import pkgutil
import re
from bisect import bisect_left, bisect_right
from collections import OrderedDict
from functools import lru_cache
from itertools import accumulate, islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from drawlake.llm.common import documents, whole_text_batches

THRESHOLD = 0.7
#: Notices, single sentences and opening paragraphs, not whole licences. The sentences of MIT, CC BY-NC,
#: GPL 3 and Apache (the short one) are word for word the lines planted in the test tables.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("bsd-2-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd-3-clause", "Released under the BSD 3-Clause License."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("lgpl-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("mit", "Released under the MIT License."),
    ("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
)
#: Whole licences as published; of Creative Commons only the sentences above are there.
FULL_TEXTS = tuple(
    (name, pkgutil.get_data("drawlake.llm", f"license_texts/{name}.txt").decode())
    for name in ("apache-2.0", "bsd-2-clause", "bsd-3-clause", "gpl-2.0", "gpl-3.0", "isc", "lgpl-3.0", "mit", "mpl-2.0", "unlicense")
)
_WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def bigrams(passage: str) -> frozenset[tuple[str, str]]:
    found = _WORD.findall(passage.translate(_LOWER))
    return frozenset(zip(found, found[1:]))


@lru_cache(maxsize=4)
def _prepared(templates: tuple[tuple[str, str], ...], threshold: float):
    sets = [(name, bigrams(t)) for name, t in templates]
    ratio = threshold / (2 - threshold)
    bounds = [(name, s, len(s) * ratio, len(s) / ratio) for name, s in sets if s]
    return bounds, min(b[2] for b in bounds), frozenset().union(*[s for _, s in sets])


def _within_reach(have: set, templates, threshold: float) -> list:
    """Templates of which a text has enough bigrams for any of its passages to reach the threshold."""
    bounds, _, known = _prepared(templates, threshold)
    common = have & known
    return [b for b in bounds if len(common) >= b[2] - 1e-9 and len(common & b[1]) >= b[2] - 1e-9]


def _passages(lines: list[list[str]], bounds, threshold: float) -> list[tuple[int, int, float, str]]:
    """``(line, template, -dice, licence)`` of the lines and the whole text, -1, that reach the threshold; templates count within bounds."""
    least = min(b[2] for b in bounds)
    out = []
    for i, found in enumerate([*lines, [w for words in lines for w in words]] if len(lines) > 1 else lines):
        if len(found) - 1 < least - 1e-9:
            continue
        have = set(zip(found, found[1:]))
        n, best = len(have), None
        for k, (name, s, low, high) in enumerate(bounds):
            if low - 1e-9 <= n <= high + 1e-9:
                dice = 2 * len(have & s) / (n + len(s))
                if dice >= threshold and (best is None or (-dice, name) < best[1:]):
                    best = (k, -dice, name)
        if best:
            out.append((-1 if i == len(lines) else i, *best))
    return out


def scan_text(text: str | None, templates=TEMPLATES, threshold: float = THRESHOLD) -> list[tuple[int, str, float]]:
    """``(line, licence, dice)`` of each line that reaches the threshold, with its best licence (ties: by name); line -1 is the whole text."""
    if not text:
        return []
    lines = [_WORD.findall(line) for line in text.translate(_LOWER).split("\n")]
    found = [w for words in lines for w in words]
    bounds = _within_reach(set(zip(found, found[1:])), templates, threshold)
    return [(i, name, -dice) for i, _, dice, name in _passages(lines, bounds, threshold)] if bounds else []


def _segments(grams: list, at: list[int], need: float, high: float):
    """Runs of hits that one window can join: between neighbours stand no more distinct bigrams than a window has room for."""
    start = 0
    for k in range(1, len(at) + 1):
        if k < len(at):
            gap = at[k] - at[k - 1] - 1
            if gap <= high - need or len(set(grams[at[k - 1] + 1 : at[k]])) <= high - need + 1e-9:
                continue
        if k - start >= need:
            yield at[start], at[k - 1] + 1
        start = k


def _windows(grams: list, previous: list[int], template: frozenset, low: float, high: float, threshold: float):
    """``(dice, first, last)`` of the best windows of bigrams that do not overlap. Any number of words is tried, from every hit to every later one.

    Of the windows that end at a place and hold the same bigrams the shortest counts, so that only the last places of
    different bigrams are begins: as many as the largest window may hold, however often they repeat.
    """
    n, most, found = len(template), int(high + 1e-9), []
    for begin, end in _segments(grams, [i for i, g in enumerate(grams) if g in template], low - 1e-9, high + 1e-9):
        recent: OrderedDict[int, bool] = OrderedDict()
        for r in range(begin, end):
            recent.pop(previous[r], None)
            recent[r] = hit = grams[r] in template
            if len(recent) > most:
                recent.popitem(last=False)
            if hit and recent:
                hits = np.cumsum(np.fromiter(reversed(recent.values()), np.int32, len(recent)))
                dice = 2 * hits / (np.arange(1, len(recent) + 1) + n)
                k = int(dice.argmax())
                if dice[k] >= threshold:
                    found.append((-dice[k], next(islice(reversed(recent), k, None)), r))
    taken: list[tuple[int, int]] = []
    for dice, first, last in sorted(found):
        k = bisect_left(taken, (first, last))
        if (k == len(taken) or taken[k][0] > last) and (k == 0 or taken[k - 1][1] < first):
            taken.insert(k, (first, last))
            yield -dice, first, last


def find_licenses(text: str | None, templates=TEMPLATES + FULL_TEXTS, threshold: float = THRESHOLD) -> list[tuple[int, str, float]]:
    """What ``scan_text`` finds, whole licences as well, then notices in windows of words that it misses, with the line where they begin.

    A window may span lines or be a part of one. Bigrams that a passage shares with its template are not counted again
    for a window; what has the most bigrams beyond the threshold goes first. A line or whole text that is no more than a
    part of another licence's larger window is left out.
    """
    if not text:
        return []
    lines = [_WORD.findall(line) for line in text.translate(_LOWER).split("\n")]
    found = [w for words in lines for w in words]
    grams = list(zip(found, found[1:]))
    bounds = _within_reach(set(grams), templates, threshold)
    if not bounds:
        return []
    starts = list(accumulate(map(len, lines), initial=0))
    claimed = bytearray(len(grams))
    own = {name: bytearray(len(grams)) for name, *_ in bounds}  # by passages of the licence itself

    def claim(by: bytearray, first: int, last: int, template: frozenset) -> None:
        for i in range(first, last + 1):
            by[i] |= grams[i] in template

    found = []
    for i, k, dice, name in _passages(lines, bounds, threshold):
        first, last = (0, len(grams) - 1) if i < 0 else (starts[i], starts[i + 1] - 2)
        size = len(set(grams[first : last + 1])) + len(bounds[k][1])
        found.append((-(-dice - threshold) * size, 0, name, first, last, -dice, size, bounds[k][1], i))
        claim(own[name], first, last, bounds[k][1])
    seen: dict = {}
    previous = []
    for i, g in enumerate(grams):
        previous.append(seen.get(g, -1))
        seen[g] = i
    for name, s, low, high in bounds:
        for dice, first, last in _windows(grams, previous, s, low, high, threshold):
            size = len(set(grams[first : last + 1])) + len(s)
            found.append((-(dice - threshold) * size, 1, name, first, last, float(dice), size, s, bisect_right(starts, first) - 1))
    out, taken = [], {}
    for _, window, name, first, last, dice, size, s, line in sorted(found, key=lambda f: f[:5]):
        # A window must stand on bigrams of its own; a line or whole text gives way only to windows of other licences.
        held = [claimed] if window else [c for n, c in taken.items() if n != name]
        fresh = [i for i in range(first, last + 1) if grams[i] in s and not any(c[i] for c in held)]
        if 2 * len({grams[i] for i in fresh}) / size >= threshold:
            # One that the licence's own passages already tell is not told again, but keeps others away.
            if not window or 2 * len({grams[i] for i in fresh if not own[name][i]}) / size >= threshold:
                out.append((window, line if line >= 0 else len(lines), name, dice, line))
            claim(claimed, first, last, s)
            if window:
                claim(taken.setdefault(name, bytearray(len(grams))), first, last, s)
    return [(line, name, dice) for _, _, name, dice, line in sorted(out)]


def _scan(text: pd.Series) -> pd.Series:
    return text.map(lambda t: [dict(zip(("line", "license", "dice"), m, strict=True)) for m in find_licenses(t)])


def scan_licenses(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, matches`` (array of line, license, dice); none for null and empty texts.

    Texts are searched whole; of licences that tie at a place the first by name counts. Repeated rows stay, an empty table
    gives an empty result, other columns are ignored.
    """
    found = pandas_udf(_scan, "array<struct<line:int,license:string,dice:double>>")(F.col(text).cast("string"))
    return docs.select(F.col(doc_id).alias("doc_id"), found.alias("matches"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, n_passages, best_dice, licenses`` (distinct, sorted, comma-joined) for each document."""
    whole_text_batches(spark)
    m = scan_licenses(documents(spark, sf_dir))
    return m.select(
        "doc_id",
        F.size("matches").cast("long").alias("n_passages"),
        F.array_max("matches.dice").alias("best_dice"),
        F.array_join(F.array_sort(F.array_distinct("matches.license")), ",").alias("licenses"),
    )


def _sql() -> str:
    values = ", ".join(f"({k}, '{n}', '{t.translate(_LOWER).replace(chr(39), chr(39) * 2)}')" for k, (n, t) in enumerate(TEMPLATES))
    grams = r"[t[1] || ' ' || t[2] FOR t IN list_zip(w[:-2], w[2:])]"
    return rf"""
WITH tpl(k, license, txt) AS (VALUES {values}),
tw AS (SELECT k, license, regexp_extract_all(txt, '[a-z0-9]+(?:\.[0-9]+)*') AS w FROM tpl),
tb AS (SELECT k, license, list_distinct({grams}) AS b FROM tw WHERE len(w) > 1),
d AS (SELECT row_number() OVER () AS rid, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
ps AS (SELECT rid, i, string_split(t, chr(10))[i] AS p FROM d, range(1, len(string_split(t, chr(10))) + 1) r(i)
       UNION ALL SELECT rid, 0, t FROM d WHERE contains(t, chr(10))),
pw AS (SELECT rid, i, regexp_extract_all(p, '[a-z0-9]+(?:\.[0-9]+)*') AS w FROM ps),
pb AS (SELECT rid, i, list_distinct({grams}) AS b FROM pw WHERE len(w) > 1),
sc AS (SELECT rid, i, license, 2 * len(list_intersect(pb.b, tb.b))::DOUBLE / (len(pb.b) + len(tb.b)) AS dice FROM pb, tb
       WHERE len(pb.b) BETWEEN len(tb.b) * {THRESHOLD} / (2 - {THRESHOLD}) - 1e-9 AND len(tb.b) * (2 - {THRESHOLD}) / {THRESHOLD} + 1e-9),
best AS (SELECT rid, i, license, dice FROM sc WHERE dice >= {THRESHOLD} QUALIFY row_number() OVER (PARTITION BY rid, i ORDER BY dice DESC, license) = 1)
SELECT d.doc_id, count(i)::BIGINT AS n_passages, max(dice) AS best_dice, coalesce(string_agg(DISTINCT license, ',' ORDER BY license), '') AS licenses
FROM d LEFT JOIN best USING (rid) GROUP BY d.rid, d.doc_id
"""


SQL = _sql()
