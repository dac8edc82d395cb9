"""Operator 9, license scans by conditional compression.

A text's candidate blocks are its runs of lines between blank ones that hold a license
cue, so a notice may be wrapped over lines, with comment marks before them. What is
compared is compressed alone and with a template as a raw zstandard dictionary; the
reduction is how much smaller that makes it. All templates are compared word for
word, at every place of the block where an unchanged piece of the template stands. Of
notices that overlap, that with most words shared, less differences, stays, the
reduction deciding between equal ones; its differences are part of the result.

Edge cases: null or empty text has no block; a line with a cue outside of all notices
is returned with license null, so nothing that looks like a license is lost; equal
lines in a text are each returned, and of templates with equal words and reduction the
first decides; rows with equal ids and repeated rows each get their blocks; only the id
and the text are read, so no other column can clash; an empty table gives an empty
result; very long lines are searched in time linear in their length.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import common

# The wording of common license notices and the paragraphs of short licenses, by SPDX identifier. Paragraphs that several licenses share are left out.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "ISC": [
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "0BSD": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."],
    "Zlib": [
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    ],
    "BSL-1.0": [
        "Distributed under the Boost Software License, Version 1.0.",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "LGPL-3.0": [
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "LGPL-2.1": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ],
    "AGPL-3.0": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "BSD-3-Clause": [
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ],
    "BSD-2-Clause": ["Released under the BSD 2-Clause License."],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "CC0-1.0": ["Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    ],
    "LicenseRef-All-Rights-Reserved": ["All rights reserved."],
}
MARKS = "#*/;%>|-"  # stand before the lines of a comment
GAP = rf"[ \t\r\n{MARKS}]+"
CUE = rf"(?i)licen[cs]|copyright|©|rights{GAP}reserved|creative{GAP}commons|\bcc{GAP}by\b|\bcc0\b|public{GAP}domain|permission{GAP}is{GAP}(?:hereby|granted)|permission{GAP}to{GAP}use|is{GAP}free{GAP}software|obtain{GAP}one{GAP}at|anyone{GAP}is{GAP}free|redistribution{GAP}and{GAP}use"
WORD = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")


LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}  # keeps places as they are


def words_of(text: str) -> list[str]:
    return WORD.findall(text.translate(LOWER))


def blocks(text: str) -> Iterator[tuple[int, str]]:
    """(number of its first line, block): runs of lines between blank ones, or ones of comment marks only."""
    run: list[str] = []
    for n, line in enumerate(text.split("\n"), 1):
        if line.strip().strip(MARKS + " \t"):
            run.append(line)
        elif run:
            yield n - len(run), "\n".join(run)
            run = []
    if run:
        yield n + 1 - len(run), "\n".join(run)


class Scanner:
    def __init__(self, templates: dict[str, list[str]], level: int = 3):
        self.templates = [(name, t, words_of(t)) for name, own in templates.items() for t in own]
        self.plain = zstandard.ZstdCompressor(level=level, write_content_size=False)
        self.with_template = [zstandard.ZstdCompressor(level=level, write_content_size=False, dict_data=zstandard.ZstdCompressionDict(t.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for _, t, _ in self.templates]

    def rank(self, block: str) -> list[tuple[float, int]]:
        """(share of the size that the template saves, template), best first; of equal ones that whose words are nearest in number."""
        data, n = block.encode(), len(words_of(block))
        alone = len(self.plain.compress(data))
        sizes = [(1 - len(c.compress(data)) / alone, i) for i, c in enumerate(self.with_template)]
        return sorted(sizes, key=lambda x: (-x[0], abs(len(self.templates[x[1]][2]) - n), x[1]))

    @staticmethod
    def differences(template: list[str], part: list[str]) -> tuple[list[str], list[str]]:
        """(words the part lacks, words it adds): as few as can be."""
        n, m = len(template), len(part)
        common = [[0] * (m + 1) for _ in range(n + 1)]  # longest common subsequence of the ends from i and j
        for i in range(n - 1, -1, -1):
            for j in range(m - 1, -1, -1):
                common[i][j] = common[i + 1][j + 1] + 1 if template[i] == part[j] else max(common[i + 1][j], common[i][j + 1])
        lacks, adds, i, j = [], [], 0, 0
        while i < n or j < m:
            if i < n and j < m and template[i] == part[j]:
                i, j = i + 1, j + 1
            elif j == m or (i < n and common[i + 1][j] >= common[i][j + 1]):
                lacks.append(template[i])
                i += 1
            else:
                adds.append(part[j])
                j += 1
        return lacks, adds

    @staticmethod
    def with_edges(template: list[str], words: list[str], at: int, to: int) -> tuple[int, int]:
        """The stretch with the words that stand where it lacks the template's first or last ones: those are other words, not just missing."""
        shared = SequenceMatcher(None, template, words[at:to], autojunk=False).get_matching_blocks()[:-1]
        if not shared:
            return at, to
        (a, b, _), (c, d, size) = shared[0], shared[-1]
        return max(0, at - max(0, a - b)), min(len(words), to + max(0, len(template) - c - size - (to - at - d - size)))

    def regions(self, words: list[str], most: float) -> Iterator[tuple[int, int, int]]:
        """(template, from, to) of every stretch that can hold the template with up to `most` differences a word: of one more pieces than differences allowed, one is in it unchanged."""
        sizes: dict[int, dict[tuple[str, ...], list[tuple[int, int]]]] = {}
        bounds = [min(int(most * len(t) + 1e-9), len(t) - 1) for _, _, t in self.templates]
        for i, (_, _, t) in enumerate(self.templates):
            cuts = [len(t) * x // (bounds[i] + 1) for x in range(bounds[i] + 2)]
            for at, to in zip(cuts, cuts[1:], strict=False):
                sizes.setdefault(to - at, {}).setdefault(tuple(t[at:to]), []).append((i, at))
        found: dict[int, list[tuple[int, int]]] = {}
        for size, pieces in sizes.items():
            firsts = {x[0] for x in pieces}
            for p in range(len(words) - size + 1):
                if words[p] in firsts:
                    for i, at in pieces.get(tuple(words[p : p + size]), ()):
                        start = p - at - bounds[i]
                        found.setdefault(i, []).append((max(start, 0), min(start + len(self.templates[i][2]) + 2 * bounds[i], len(words))))
        for i, spans in found.items():
            spans.sort()
            at, to = spans[0]
            for x, y in spans[1:]:
                if x > to:
                    yield i, at, to
                    at = x
                to = max(to, y)
            yield i, at, to

    def stretches(self, words: list[str], most: float) -> list[tuple[int, int, int, int]]:
        """(score, template, from, to) of every stretch within the bound, best first; score: words shared less differences."""
        out = []
        for i, at, to in self.regions(words, most):
            t = self.templates[i][2]
            n, bound = len(t), most * len(t) + 1e-9
            last, begun = list(range(n + 1)), [at] * (n + 1)  # differences of the template's first words to the best stretch that ends here, and its start
            for j in range(at, to):
                now, start = [0], [j + 1]
                for k, x in enumerate(t):
                    if x == words[j]:
                        now.append(last[k])
                        start.append(begun[k])
                    elif now[k] < last[k + 1]:
                        now.append(now[k] + 1)
                        start.append(start[k])
                    else:
                        now.append(last[k + 1] + 1)
                        start.append(begun[k + 1])
                last, begun = now, start
                if last[n] <= bound and start[n] <= j:
                    x, y, lost = start[n], j + 1, 0
                    if last[n]:
                        x, y = self.with_edges(t, words, x, y)
                        lost = sum(map(len, self.differences(t, words[x:y])))
                    if lost <= bound:
                        out.append(((n + y - x - 3 * lost) // 2, i, x, y))
        return sorted(out, key=lambda x: (-x[0], x[3] - x[2], x[2], x[1]))

    def saving(self, i: int, text: str) -> float:
        data = text.encode()
        return 1 - len(self.with_template[i].compress(data)) / len(self.plain.compress(data))

    def notices(self, block: str, cue: re.Pattern, most: float) -> list[tuple[int, str, str | None, float, list[str], list[str]]]:
        """(line within the block, its text, license, reduction, words lacking, words added) of each notice of the block, and with license None of each line with a cue outside of them.

        Of notices that overlap the one with the best score stays, of equal ones that whose template saves most.
        """
        spots = [x.span() for x in WORD.finditer(block.translate(LOWER))]
        words = words_of(block)
        starts = [0, *(x.end() for x in re.finditer("\n", block))]

        def lines(at: int, to: int) -> tuple[int, int]:
            end = block.find("\n", to)
            return starts[bisect_right(starts, at) - 1], len(block) if end < 0 else end

        held = []
        for score, i, at, to in self.stretches(words, most):
            x, y = spots[at][0], spots[to - 1][1]
            a, b = lines(x, y)
            alone = (not at or spots[at - 1][1] <= a) and (to == len(spots) or spots[to][0] >= b)
            held.append((-score, -self.saving(i, block[a:b] if alone else block[x:y]), at, to, i))
        out, taken = [], bytearray(len(block))
        for _, saved, at, to, i in sorted(held):
            x, y = spots[at][0], spots[to - 1][1]
            if not any(taken[x:y]):
                taken[x:y] = b"\1" * (y - x)
                a, b = lines(x, y)
                out.append((x, a, b, self.templates[i][0], -saved, *self.differences(self.templates[i][2], words[at:to])))
        rest: dict[tuple[int, int], int] = {}
        for found in cue.finditer(block):
            if not any(taken[found.start() : found.end()]):
                rest.setdefault(lines(found.start(), found.end()), found.start())
        out += [(at, a, b, None, self.rank(block[a:b])[0][0], [], []) for (a, b), at in rest.items()]
        return [(bisect_right(starts, a) - 1, block[a:b], *x) for _, a, b, *x in sorted(out, key=lambda x: x[0])]

    def scan(self, block: str, most: float) -> tuple[str | None, float, list[str], list[str]]:
        """(license, reduction, words lacking, words added) of the block's first notice; None if no template is confirmed."""
        known = [x[2:] for x in self.notices(block, re.compile(CUE), most) if x[2]]
        return known[0] if known else (None, self.rank(block)[0][0], [], [])


FOUND = "doc_id long, line int, block string, license string, reduction double, lacks array<string>, adds array<string>"


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, *, id_col: str = "doc_id", text_col: str = "text", most: float = 0.1) -> DataFrame:
    """A row for each notice of a block, and one for each line with a cue outside of notices. most: wording differences, as a share of the template's words."""
    templates = templates or TEMPLATES
    cue = re.compile(CUE)
    made: list[Scanner] = []

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(Scanner(templates))
        for b in common.slices(batches):
            out = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                for n, block in blocks(text):
                    if cue.search(block):
                        out += [(doc, n + at, *found) for at, *found in made[0].notices(block, cue, most)]
            cols = list(zip(*out, strict=True)) or [()] * 7
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "line", "block", "license", "reduction", "lacks", "adds"])

    # texts without a cue never leave the JVM
    return docs.where(F.col(text_col).rlike(CUE)).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(kernel, FOUND)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents"))


QUERIES = {"op9_license_scan": op9_license_scan}
