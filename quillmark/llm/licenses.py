"""License scan by conditional compression.

Candidate blocks - lines, or runs of lines, that speak of a license - are
compressed alone and with each license template as a raw zstandard
dictionary.  Templates are ranked by how much smaller the block gets; the best
ones are confirmed by the exact wording: the words in which block and template
differ must not include any that tells licenses apart (names, versions,
clauses), and enough of the template must be there.
"""

from __future__ import annotations

import difflib
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Public license notices (fixed values), by SPDX identifier; BSD stands for the
#: notice whose clauses are not shown.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    ),
    "MIT": (
        "Released under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ),
    "BSD": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",),
    "BSD-2-Clause": (
        "Licensed under the BSD 2-Clause License.",
        "Licensed under the Simplified BSD License.",
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    ),
    "BSD-3-Clause": (
        "Licensed under the BSD 3-Clause License.",
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    ),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    "LGPL-2.1": ("This work is licensed under the GNU Lesser General Public License, version 2.1.",),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.",),
    "AGPL-3.0": ("This work is licensed under the GNU Affero General Public License, version 3.",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0."),
    "ISC": (
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "CC0-1.0": ("Licensed under CC0 1.0 Universal.",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-ND-4.0": ("Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    "CC-BY-NC-SA-4.0": ("Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    "CC-BY-NC-ND-4.0": ("Licensed under CC BY-NC-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
}
#: Words that tell licenses apart (fixed values); all numbers do as well.
TELLING = frozenset(
    "apache mit bsd gnu general lesser affero public mozilla isc cc cc0 by sa nc nd by-sa by-nc by-nd by-nc-sa by-nc-nd creative commons attribution sharealike noncommercial noderivatives simplified clause 2-clause 3-clause free unencumbered domain universal neither endorse promote".split()
)
CUE = r"(?i)licen[cs]e|permission is hereby|redistribution and use|creative commons|public domain|copyright"
#: Share of the template's words that must be there.
LEAST_SHARE = 0.8

_WORD = re.compile(r"[0-9]+(?:\.[0-9]+)*|[A-Za-z0-9]+(?:-[A-Za-z0-9]+)*")


def _words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


#: Words of a window before and after the start of a line with a cue.
WORDS_BEFORE = 20
WORDS_AFTER = 20 + max(len(_words(t)) for texts in TEMPLATES.values() for t in texts)


def blocks(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of candidate blocks: each line with a cue, and round it the
    lines that the longest notice, wrapped, may go on in."""
    cue = re.compile(CUE)
    lines = [(m.start(), m.end()) for m in re.finditer(r"[^\n]+", text)]
    marked = [i for i, (a, b) in enumerate(lines) if cue.search(text, a, b)]
    sizes: dict[int, int] = {}

    def size(i: int) -> int:
        if i not in sizes:
            sizes[i] = len(_WORD.findall(text, *lines[i]))
        return sizes[i]

    for i in marked:
        yield lines[i]
        low, high, before, after = i, i, 0, size(i)
        while low > 0 and i - low < WORDS_BEFORE and before < WORDS_BEFORE:
            low -= 1
            before += size(low)
        while high + 1 < len(lines) and high - i < WORDS_AFTER and after < WORDS_AFTER:
            high += 1
            after += size(high)
        if low < high:
            yield lines[low][0], lines[high][1]


class _Matcher:
    def __init__(self) -> None:
        import zstandard

        self.plain = zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False)
        self.templates, self.counts = [], []
        for name, texts in TEMPLATES.items():
            for text in texts:
                low = text.lower()
                data = zstandard.ZstdCompressionDict(low.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                self.counts.append(Counter(_words(text)))
                self.templates.append((name, _words(text), zstandard.ZstdCompressor(level=3, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False)))

    def _pieces(self, block: str) -> Iterator[tuple[int, str]]:
        """The block and, if it is long, its sentences, so that a notice inside
        a paragraph is seen by itself."""
        yield 0, block
        if len(block) > 120:
            for m in re.finditer(r"[^.!?\n]*(?:[.!?](?=[^\s])[^.!?\n]*)*[.!?]?", block):
                if m[0].strip() and re.search(CUE, m[0]):
                    yield m.start(), m[0]

    def match(self, block: str) -> list[tuple[int, int, str, float]]:
        """(start, end, license, size reduction) of confirmed licenses."""
        out = {}
        for offset, piece in self._pieces(block):
            data = piece.lower().encode()
            alone = len(self.plain.compress(data))
            ranked = sorted(((alone - len(c.compress(data)), i) for i, (_, _, c) in enumerate(self.templates)), key=lambda x: (-x[0], x[1]))
            words = _words(piece)
            held = Counter(words)
            for saved, i in ranked:
                name, wanted, _ = self.templates[i]
                if saved <= 0:
                    break
                # matched words are no more than the words in common, in any order
                if sum(min(n, held[w]) for w, n in self.counts[i].items()) < LEAST_SHARE * len(wanted):
                    continue
                where = self._confirmed(words, wanted)
                if where is not None:
                    marks = [m.span() for m in _WORD.finditer(piece.lower())]
                    low, high = offset + marks[where[0]][0], offset + marks[where[1]][1]
                    best = out.get(name)
                    if best is None or high - low < best[1] - best[0]:
                        out[name] = (low, high, name, saved / max(1, alone))
                    break
        return sorted(out.values())

    @staticmethod
    def _confirmed(words: list[str], wanted: list[str]) -> tuple[int, int] | None:
        """First and last word of the block that stand for the template, if the
        wording differs in no word that tells licenses apart."""
        parts = [m for m in difflib.SequenceMatcher(None, words, wanted, autojunk=False).get_matching_blocks() if m.size]
        if not parts or sum(m.size for m in parts) < LEAST_SHARE * len(wanted):
            return None
        first, last = parts[0].a, parts[-1].a + parts[-1].size - 1
        shared = {j for m in parts for j in range(m.b, m.b + m.size)}
        mine = {i for m in parts for i in range(m.a, m.a + m.size)}
        missing = [w for j, w in enumerate(wanted) if j not in shared]
        extra = [w for i, w in enumerate(words[first : last + 2], first) if i not in mine]
        if any(w in TELLING or w[0].isdigit() for w in missing + extra):
            return None
        return first, last


def licenses(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_licenses (distinct), licenses (sorted),
    found (license, start, end, saved: share of the block's size saved).

    Null and empty texts have none; rows without id and repeated rows are rows
    like any other; other columns are ignored; an empty table gives no rows.
    """

    @F.arrow_udf("array<struct<license:string,start:int,end:int,saved:double>>")
    def scan(texts: pa.Array) -> pa.Array:
        matcher, out = _Matcher(), []
        for text in texts.to_pylist():
            found: dict[tuple[int, int, str], float] = {}
            for low, high in blocks(text or ""):
                for a, b, name, saved in matcher.match(text[low:high].replace("\n", " ")):  # wrapped sentences are whole
                    key = (low + a, low + b, name)
                    found[key] = max(saved, found.get(key, 0.0))
            # of one license the narrowest place; what a fuller notice of the family holds is part of that
            family = [k for k in found if not any(o[2] != k[2] and o[2].startswith(f"{k[2]}-") and o[0] <= k[0] and o[1] >= k[1] for o in found)]
            inner = [k for k in family if not any(o != k and o[2] == k[2] and o[0] >= k[0] and o[1] <= k[1] for o in family)]
            out.append([{"license": k[2], "start": k[0], "end": k[1], "saved": found[k]} for k in sorted(inner)])
        kind = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("saved", pa.float64())]))
        return pa.array(out, kind)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = texts.select("doc_id", scan(F.when(F.rlike("text", F.lit(CUE)), F.col("text"))).alias("found"))
    names = F.array_sort(F.array_distinct(F.transform("found", lambda f: f["license"])))
    return found.select("doc_id", F.size(names).cast("long").alias("n_licenses"), names.alias("licenses"), "found")
