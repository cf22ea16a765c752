"""License scan by conditional compression.

A candidate block starts where a statement about a license may: at the beginning
of a sentence that holds a cue, or at a word near before the cue with which a template begins. It is
compressed with each template as a raw zstandard dictionary; templates are
ranked by how much smaller that makes the block than compressing it alone. The
best ones are then confirmed by the exact differences in wording: of the templates whose
changed words are few enough and none of whose telling words
(names, versions) changed, the one that explains most words wins. SPDX tags are templates like
others. Where a statement goes on with "and", "or" or a comma, the names of further licenses are
ranked and confirmed in the same way.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.llm.common import small_batches, text_of

#: Templates that the ranking passes on, the share of a template's words that may differ, and compression level.
CONFIRM, MAX_CHANGED, LEVEL = 8, 0.15, 3
#: A block is this much longer than its template at most; a changed word weighs as much as this many words that agree.
ROOM, COST = 1.25, 5
#: Blocks that a task remembers.
MEMO = 2_000
#: Characters before a cue in which a statement may begin with a template's first word.
BEFORE = 200


@dataclass(frozen=True)
class Template:
    """A license statement, and the words in it that must be the same."""

    license: str
    text: str
    telling: tuple[str, ...]


#: Statements by which public licenses are declared.
TEMPLATES = (
    Template("MIT", "Released under the MIT License.", ("mit",)),
    Template("MIT", "This project is licensed under the terms of the MIT license.", ("mit",)),
    Template("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:", ("permission", "charge", "sublicense")),
    Template("Apache-2.0", "Licensed under the Apache License, Version 2.0.", ("apache", "2.0")),
    Template("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at", ("apache", "2.0", "compliance")),
    Template("GPL-2.0", "This work is licensed under the GNU General Public License, version 2.", ("gnu", "general", "public", "2")),
    Template("GPL-3.0", "This work is licensed under the GNU General Public License, version 3.", ("gnu", "general", "public", "3")),
    Template("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", ("gnu", "general", "2", "later")),
    Template("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", ("gnu", "general", "3", "later")),
    Template("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3.", ("gnu", "lesser", "3")),
    Template("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3.", ("gnu", "affero", "3")),
    Template("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", ("redistribution", "source", "binary")),
    Template("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.", ("redistribution", "source", "binary")),
    Template("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.", ("redistribution", "source", "binary", "endorse", "promote")),
    Template("BSD", "Released under the BSD License.", ("bsd",)),
    Template("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", ("permission", "fee", "notice")),
    Template("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", ("mozilla", "2.0")),
    Template("Unlicense", "This is free and unencumbered software released into the public domain.", ("unencumbered", "public", "domain")),
    Template("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", ("unencumbered", "public", "domain")),
    Template("Zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.", ("permission", "alter", "misrepresented")),
    Template("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.", ("permission", "charge", "sublicense")),
    Template("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.", ("permission", "fee", "notice")),
    Template("CC-BY-4.0", "Licensed under CC BY 4.0.", ("by", "4.0")),
    Template("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License.", ("attribution", "4.0")),
    Template("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0.", ("by-sa", "4.0")),
    Template("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", ("attribution-sharealike", "4.0")),
    Template("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0.", ("by-nc", "4.0")),
    Template("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", ("attribution-noncommercial", "4.0")),
    Template("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide.", ("dedicated", "public", "domain")),
)

#: Identifiers of public licenses in SPDX tags.
SPDX = (
    "0BSD", "AFL-3.0", "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-1.1", "Apache-2.0", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-3.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-NC-SA-4.0",
    "CC-BY-SA-3.0", "CC-BY-SA-4.0", "CC0-1.0", "CDDL-1.0", "EPL-1.0", "EPL-2.0", "EUPL-1.2", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "ISC",
    "LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MIT-0", "MPL-1.1", "MPL-2.0", "MS-PL", "NCSA", "OFL-1.1", "PSF-2.0", "Unlicense", "WTFPL", "Zlib",
)

TEMPLATES += tuple(Template(x, f"SPDX-License-Identifier: {x}", ("spdx-license-identifier", x.lower())) for x in SPDX)

#: How statements name a license after "and" or "or".
NAMES = (
    Template("MIT", "MIT License", ("mit",)), Template("Apache-2.0", "Apache License, Version 2.0", ("apache", "2.0")), Template("GPL-2.0", "GNU General Public License, version 2", ("gnu", "general", "public", "2")),
    Template("GPL-3.0", "GNU General Public License, version 3", ("gnu", "general", "public", "3")), Template("LGPL-3.0", "GNU Lesser General Public License, version 3", ("gnu", "lesser", "3")), Template("BSD", "BSD License", ("bsd",)),
    Template("MPL-2.0", "Mozilla Public License, Version 2.0", ("mozilla", "2.0")), Template("CC-BY-4.0", "CC BY 4.0", ("by", "4.0")), Template("CC-BY-SA-4.0", "CC BY-SA 4.0", ("by-sa", "4.0")), Template("CC-BY-NC-4.0", "CC BY-NC 4.0", ("by-nc", "4.0")),
    *(Template(x, x, (x.lower(),)) for x in SPDX),
)

CUE = re.compile(r"licen[sc]ed?\b|copyright|permission|redistribut|public domain|spdx", re.I)
_SENTENCE = re.compile(r"(?<=[.!?:;])\s|\n")
_NEXT = re.compile(r"[\s)]*(?:,\s*)?(?:and|or|and/or|/|,|with)[\s(]+(?:(?:under|the|terms|of)\s+)*", re.I)
_WORD = re.compile(r"[\w.+-]*\w")


def wording(text: str) -> list[str]:
    """Words in lower case without the punctuation around them; versions such as 2.0 and names such as by-nc are one word."""
    return [w.lstrip(".+-") for w in _WORD.findall(text.lower())]


def changes(block: Sequence[str], template: Sequence[str]) -> list[tuple[str, str, str]]:
    """(kind, words of the template, words of the block) that differ, exactly."""
    ops = SequenceMatcher(None, template, block, autojunk=False).get_opcodes()
    return [(kind, " ".join(template[a:b]), " ".join(block[c:d])) for kind, a, b, c, d in ops if kind != "equal"]


class Scanner:
    """The templates with a compressor each, made once for a task."""

    def __init__(self, templates: Sequence[Template] = TEMPLATES, names: Sequence[Template] = NAMES) -> None:
        import zstandard

        self.templates = [*templates, *names]
        self.main, self.further = range(len(templates)), range(len(templates), len(templates) + len(names))
        self.words = [wording(t.text) for t in self.templates]
        firsts = sorted({re.match(r"\w+", t.text)[0] for t in templates})
        self.first = re.compile(r"\b(?:" + "|".join(map(re.escape, firsts)) + r")\b", re.I)
        self.reach = max(int(len(t.text) * ROOM) + 8 for t in self.templates)
        self.seen: dict[tuple, tuple | None] = {}  # what blocks were found to be: repeated lines are judged once
        self.alone = zstandard.ZstdCompressor(level=LEVEL)
        self.given = [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(t.text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for t in self.templates]

    def reductions(self, blocks: dict[int, str]) -> dict[int, float]:
        """For each template, by what share its dictionary makes its block smaller."""
        out = {}
        plain: dict[str, int] = {}
        for n, block in blocks.items():
            raw = block.encode("utf-8", "surrogatepass")
            size = plain.get(block) or plain.setdefault(block, len(self.alone.compress(raw)))
            out[n] = 1 - len(self.given[n].compress(raw)) / size
        return out

    def _block(self, text: str, start: int, n: int) -> str:
        """From ``start`` as many characters as template ``n`` takes, with room."""
        return text[start : start + int(len(self.templates[n].text) * ROOM) + 8]

    def _fit(self, block: str, n: int) -> tuple[int, int, list[tuple[str, str, str]]] | None:
        """Changes between template ``n`` and the words of ``block`` as far as the template goes: (their number, end, changes), None if too many or telling."""
        found = [(m.group().lower().lstrip(".+-"), m.end()) for m in _WORD.finditer(block)]
        template = self.words[n]
        have = [w for w, _ in found]
        if len(set(template) - set(have)) > MAX_CHANGED * len(template):  # each missing word is a change
            return None
        match = SequenceMatcher(None, template, have, autojunk=False).get_matching_blocks()
        last = max((m.b + m.size for m in match if m.size), default=0)
        if not last:
            return None
        differ = changes(have[:last], template)
        number = sum(max(len(a.split()), len(b.split())) for _, a, b in differ)
        changed = {w for _, a, _ in differ for w in a.split()}
        if number > MAX_CHANGED * len(template) or changed & set(self.templates[n].telling):
            return None
        return number, found[last - 1][1], differ

    def _worth(self, n: int, number: int) -> tuple[int, int]:
        return len(self.words[n]) - COST * number, -n

    def best(self, text: str, start: int, which: range, confirm: int = CONFIRM) -> tuple[int, tuple, float] | None:
        """The template of ``which`` that a block at ``start`` is confirmed to be, with its fit and reduction; of all if ``confirm`` is their number."""
        longest = text[start : start + self.reach]
        if (key := (longest, which.start, confirm)) not in self.seen:
            if len(self.seen) >= MEMO:
                self.seen.clear()
            self.seen[key] = self._best(longest, which, confirm)
        return self.seen[key]

    def _best(self, text: str, which: Sequence[int], confirm: int) -> tuple[int, tuple, float] | None:
        blocks = {n: self._block(text, 0, n) for n in which}
        gains = self.reductions(blocks)
        ranked = sorted(gains, key=lambda n: (-gains[n], n))[:confirm]
        fits = [(n, f) for n in ranked if (f := self._fit(blocks[n], n)) is not None]
        if not fits:
            return None
        n, fit = max(fits, key=lambda x: self._worth(x[0], x[1][0]))
        return n, fit, gains[n]

    def scan(self, text: str, confirm: int = CONFIRM) -> list[tuple[str, int, int, float, int, str]]:
        """(license, start, end, reduction, changed words, changes) of each confirmed block, in order and without overlap."""
        out: list[tuple[str, int, int, float, int, str]] = []
        done, starts = 0, self.starts(text)
        for i, start in enumerate(starts):
            if start < done or not (found := self.best(text, start, self.main, confirm)):
                continue
            for later in starts[i + 1 :]:  # words before a statement, or its own first words missed, count as changes: a later start may fit better
                if not found[1][0] or later >= start + found[1][1]:
                    break
                if (other := self.best(text, later, self.main, confirm)) and self._worth(other[0], other[1][0]) > self._worth(found[0], found[1][0]):
                    start, found = later, other
            while found:
                n, (number, end, differ), gain = found
                done = start + end
                out.append((self.templates[n].license, start, done, gain, number, "; ".join(f"{k}: {a} -> {b}" for k, a, b in differ)))
                further = _NEXT.match(text, done)
                if not further:
                    break
                start = further.end()
                found = self.best(text, start, self.further, confirm)
        return out

    def starts(self, text: str) -> list[int]:
        """Where a statement may begin: at the sentences that hold a cue, and at words with which a template begins, up to BEFORE characters before the cue."""
        sentences = [0, *[m.end() for m in _SENTENCE.finditer(text)]]
        out: set[int] = set()
        for m in CUE.finditer(text):
            low = sentences[bisect_right(sentences, m.start()) - 1]
            while low < m.start() and text[low].isspace():
                low += 1
            if m.start() - low <= BEFORE:
                out.add(low)
            out.update(f.start() for f in self.first.finditer(text, max(0, m.start() - BEFORE), m.end()))
            out.add(m.start())
        return sorted(out)


def _scan(templates: Sequence[Template], fields: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for batch in batches:
            at, rows = [], []
            for i, text in enumerate(batch.column(1)):
                for row in scanner.scan(text.as_py()):
                    at.append(i)
                    rows.append(row)
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=fields)

    return run


def scan(docs: DataFrame, templates: Sequence[Template] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each license statement found: id, ``license``, ``start``, ``end`` (code points), ``reduction``, ``n_changed`` and ``changes``.

    Documents without one, null and empty texts give no row; a repeated document gives its rows each time; null
    ids stay null. Of templates that fit a block, the one with most words wins, COST taken off for each changed one, and of equal ones the first in the list.
    Whole texts are read, however long; work grows with the number of cues.
    Only texts that hold a cue leave the JVM. Only the two named columns are read.
    """
    fields = [T.StructField("id", docs.schema[id_col].dataType), T.StructField("license", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("reduction", T.DoubleType()), T.StructField("n_changed", T.LongType()), T.StructField("changes", T.StringType())]
    rows = small_batches(docs).select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).filter(F.col("text").rlike("(?i)licen[sc]ed?\\b|copyright|permission|redistribut|public domain|spdx"))
    out = rows.mapInArrow(_scan(templates, [f.name for f in fields]), T.StructType(fields))
    return out.withColumnRenamed("id", id_col)
