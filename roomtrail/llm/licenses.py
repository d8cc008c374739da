"""License scans by conditional compression.

Words around a cue are searched for every template, over white space of any kind. A
window of the template's length is compressed alone and with the template as a zstandard
raw dictionary; if that saves enough of the template's own compressed size, the exact
wording is compared, word by word, before the license is reported.
"""

from __future__ import annotations

import difflib
import functools
import re
from bisect import bisect_left, bisect_right
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\""
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_2 = _BSD + " 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_GNU = "This {0} is free software{1} you can redistribute it and/or modify it under the terms of the GNU {2} as published by the Free Software Foundation; either version {3} of the License, or (at your option) any later version."
# Names, usual wordings of notices and headers, and short licenses in full.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"],
    "BSD-2-Clause": [_BSD_2, "Licensed under the BSD 2-Clause License."],
    "BSD-3-Clause": [_BSD, _BSD_2 + " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "Licensed under the BSD 3-Clause License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991", _GNU.format("program", ";", "General Public License", "2")],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", _GNU.format("program", ":", "General Public License", "3")],
    "ISC": ["Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "LGPL-2.1": ["GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999", _GNU.format("library", ";", "Lesser General Public License", "2.1")],
    "LGPL-3.0": ["GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", _GNU.format("library", ":", "Lesser General Public License", "3")],
    "MIT": ["Released under the MIT License.", _MIT, _MIT + ", including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _AS_IS + ", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at", "Mozilla Public License Version 2.0"],
    "Public-Domain": ["This work is in the public domain.", "Released into the public domain.", "This work has been dedicated to the public domain."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}
CUE = r"(?i)licen[cs]|redistribut|permission\s+is\s+hereby|permission\s+to\s+use|public\s+domain"
#: Words searched on each side of a cue, at least.
REACH = 48
_WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")


def words(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


@functools.cache
def _packers(templates: tuple) -> tuple:
    """The plain compressor, the longest template's words, each template with its words,
    compressor and own compressed size, and the templates' places of each word pair."""
    import zstandard as z

    alone = z.ZstdCompressor(level=9, write_content_size=False)
    made, pairs = [], {}
    for i, (name, text) in enumerate(templates):
        data, own = text.lower().encode(), words(text)
        known = z.ZstdCompressionDict(data, dict_type=z.DICT_TYPE_RAWCONTENT)
        made.append((name, text, own, z.ZstdCompressor(level=9, dict_data=known, write_content_size=False, write_dict_id=False), len(alone.compress(data))))
        for k, pair in enumerate(zip(own, own[1:], strict=False)):
            pairs.setdefault(pair, []).append((i, k))
    return alone, max((len(m[2]) for m in made), default=0), made, pairs


def candidates(text: str, found: list[re.Match], reach: int) -> list[tuple[int, int]]:
    """Ranges of the words ``found`` within ``reach`` words of a cue; overlapping ones are joined."""
    starts = [m.start() for m in found]
    out: list[tuple[int, int]] = []
    for m in re.finditer(CUE, text):
        k = max(0, bisect_right(starts, m.start()) - 1)
        lo, hi = max(0, k - reach), min(len(found), k + reach + 1)
        if out and out[-1][1] >= lo:
            out[-1] = (out[-1][0], hi)
        else:
            out.append((lo, hi))
    return out


def differences(block: list[str], template: list[str]) -> tuple[list[str], list[str], int, int]:
    """Template words that the block lacks, block words between its first and last shared
    word that the template lacks, both in order, and that range of the block. Shared words
    at the ends that are farther off than they are many do not count as shared."""
    steps = difflib.SequenceMatcher(None, template, block, autojunk=False).get_matching_blocks()[:-1]
    while len(steps) > 1:
        (_, b, n), (_, b2, _) = steps[0], steps[1]
        (_, y, m), (_, z, k) = steps[-2], steps[-1]
        if b2 - b - n > n:
            steps = steps[1:]
        elif z - y - m > k:
            steps = steps[:-1]
        else:
            break
    if not steps:
        return list(template), [], 0, 0
    lo, hi = steps[0].b, steps[-1].b + steps[-1].size
    had, ours = {i for s in steps for i in range(s.a, s.a + s.size)}, {i for s in steps for i in range(s.b, s.b + s.size)}
    return [w for i, w in enumerate(template) if i not in had], [block[i] for i in range(lo, hi) if i not in ours], lo, hi


def judge_all(text: str, templates: tuple, most_missing: float, least_saving: float) -> list[tuple]:
    """(start, end, license, saving, missing, extra) of every confirmed notice, in order.

    Of overlapping ones that with most shared words less differing ones stays; then the
    longer template, then the name that sorts first.
    """
    alone, longest, made, pairs = _packers(templates)
    found = list(_WORD.finditer(text))
    own = [m.group().lower() for m in found]
    confirmed = []
    for lo, hi in candidates(text, found, max(REACH, longest)):
        hits: dict[int, Counter] = {}
        for k in range(lo, hi - 1):
            for i, at in pairs.get((own[k], own[k + 1]), ()):
                hits.setdefault(i, Counter())[k - at] += 1
        for i, begins in hits.items():
            name, template, theirs, packer, size = made[i]
            # As many words may differ; each leaves two word pairs fewer.
            slack = int(most_missing * len(theirs))
            need = max(1, len(theirs) - 1 - 2 * slack)
            places = sorted(begins)
            near = [sum(begins[p] for p in places[bisect_left(places, b - slack) : bisect_right(places, b + slack)]) for b in places]
            tried: list[int] = []
            for n, b in sorted(zip(near, places, strict=True), key=lambda x: (-x[0], x[1])):
                if n < need or any(abs(b - t) <= slack // 2 for t in tried):
                    continue
                tried.append(b)
                first, last = max(lo, b - slack), min(hi, b + len(theirs) + slack)
                data = text[found[first].start() : found[last - 1].end()].lower().encode()
                saving = (len(alone.compress(data)) - len(packer.compress(data))) / size
                if saving < least_saving:
                    continue
                missing, extra, x, y = differences(own[first:last], theirs)
                if y > x and len(missing) + len(extra) <= most_missing * len(theirs):
                    score = len(theirs) - 2 * len(missing) - len(extra) if missing or extra else len(theirs)
                    confirmed.append((-score, -len(template), name, first + x, first + y, saving, tuple(missing), tuple(extra)))
    out: list[tuple] = []
    taken: set[int] = set()
    for _, _, name, x, y, saving, missing, extra in sorted(confirmed):
        if taken.isdisjoint(range(x, y)):
            taken.update(range(x, y))
            start, end = found[x].start(), found[y - 1].end()
            while start and not text[start - 1].isspace():
                start -= 1
            while end < len(text) and not text[end].isspace():
                end += 1
            out.append((start, end, name, saving, missing, extra))
    return sorted(out)


def judge(block: str, templates: tuple, most_missing: float, least_saving: float) -> tuple | None:
    """(license, saving, missing, extra) of the longest confirmed notice of a block."""
    found = judge_all(block, templates, most_missing, least_saving)
    return max(found, key=lambda f: f[1] - f[0])[2:] if found else None


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, most_missing: float = 0.25, least_saving: float = 0.1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, license, start, end, exact, saving, missing, extra)``: one row per
    confirmed notice; spans are code points, end exclusive, and run over line feeds.

    A template is compared where it saves ``least_saving`` of its own compressed size, and
    confirmed if the words missing and added are at most ``most_missing`` of its words.
    Null texts have none; repeated rows give repeated results.
    """
    fixed = tuple((k, t) for k, own in sorted((templates or TEMPLATES).items()) for t in own)

    def rows(batch: pa.RecordBatch) -> dict:
        names = ("doc_id", "license", "start", "end", "exact", "saving", "missing", "extra")
        out: dict = {n: [] for n in names}
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for lo, hi, name, saving, missing, extra in judge_all(text, fixed, most_missing, least_saving):
                for n, v in zip(names, (doc, name, lo, hi, not (missing or extra), saving, missing, extra), strict=True):
                    out[n].append(v)
        return out

    base = docs.filter(F.col(text_col).rlike(CUE)).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, license string, start long, end long, exact boolean, saving double, missing array<string>, extra array<string>"
    return arrow_map(base, ["doc_id", "text"], schema, rows, by="text")
