"""License scans by conditional compression.

Every place of a text that mentions licensing makes candidate blocks, with as many words on both sides
as the templates of a size have (sizes are powers of two).  Blocks are compressed with each template as
zstandard raw dictionary and without any; the templates rank by how much they
save, measured against what they save on themselves.  Those above a share
are laid along the words they have in common with the block, and the exact
words in which both differ confirm them, or not.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

# Public license texts and notices by SPDX name.
_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
_BSD_TWO = (
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_THREE = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_WARRANTY = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_MIT_GRANT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: '
_MIT_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
_ISC_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER '
    "RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
    "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
    "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. "
    "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain."
)
_FULL = [
    ("MIT", _MIT_GRANT + _MIT_NOTICE + _WARRANTY),
    ("MIT", _WARRANTY),
    ("BSD-2-Clause", _BSD_GRANT + _BSD_TWO + _BSD_WARRANTY),
    ("BSD-3-Clause", _BSD_GRANT + _BSD_TWO + _BSD_THREE + _BSD_WARRANTY),
    ("ISC", _ISC_GRANT + _ISC_WARRANTY),
    ("Zlib", _ZLIB),
    ("Unlicense", _UNLICENSE),
]
_NOTICES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("EPL-2.0", "Licensed under the Eclipse Public License, Version 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("WTFPL", "Licensed under the Do What The Fuck You Want To Public License, Version 2."),
    ("Zlib", "Licensed under the zlib License."),
    ("Proprietary", "All rights reserved."),
]
_CC = ["CC0 1.0 Universal", "CC BY 4.0", "CC BY-SA 3.0", "CC BY-SA 4.0", "CC BY-NC 4.0", "CC BY-ND 4.0", "CC BY-NC-SA 4.0", "CC BY-NC-ND 4.0"]


def _spdx(name: str) -> str:
    return name.replace(" Universal", "").replace(" ", "-").replace("CC0-", "CC0-")


#: All templates: whole texts, notices, and what is said in the same words of many licenses.
TEMPLATES = [
    *_FULL,
    *_NOTICES,
    *[(_spdx(c), f"{said} {c}.") for c in _CC for said in ("Licensed under", "The license of this work is")],
    *[(n, f"SPDX-License-Identifier: {n}") for n in dict.fromkeys([*(n for n, _ in _FULL + _NOTICES if n != "Proprietary"), *map(_spdx, _CC)])],
]
#: Beginnings of words that mention licensing.
MENTIONS = re.compile(r"licen[sc]|permi|redistribut|unencumbered|spdx|warrant|^cc0?$|^reserved$|^domain$|^commons$|as.is")
#: Compared: templates that save so much of what they save on themselves. Confirmed: so alike in words, in order, and no difference in a word that tells licenses apart.
SAVED, ALIKE, LEVEL = 0.2, 0.8, 19
#: Words that tell licenses apart.  Fixed values.
TELLING = frozenset("mit apache gnu general lesser affero bsd mozilla eclipse isc zlib cc cc0 by sa nc nd clause attribution sharealike noncommercial noderivatives noderivs universal not no only public domain".split())
#: Words that deny what follows them in the sentence.  Fixed values.
DENIAL = frozenset("not no never neither nor without isn aren wasn cannot unless".split())
#: How many words before a block a denial reaches.
REACH = 5
#: Words in a row that a template has in common with a block somewhere.
SEED = 2

_WORD = re.compile(r"[^\W_]+(?:\.\d+)*")
#: Where a sentence or line ends.
_STOP = re.compile(r"[.!?;](?=\s|$)|\n")
_SPELLING = {"licence": "license", "licences": "licenses", "licenced": "licensed", "licencing": "licensing"}


def words(text: str) -> list[str]:
    return [_SPELLING.get(w, w) for w in _WORD.findall(text.lower())]


def _encoder(content: bytes | None) -> zstandard.ZstdCompressor:
    options = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
    if content is not None:
        options["dict_data"] = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(**options)


def _raw(block: list[str]) -> bytes:
    # what goes before lets the savings on short blocks count in full
    return bytes(64) + (" ".join(block) + " ").encode()


class Scanner:
    """Templates ready to compress and compare with."""

    def __init__(self, templates: list[tuple[str, str]]):
        self.names = [n for n, _ in templates]
        self.words = [words(t) for _, t in templates]
        self.plain, self.given = _encoder(None), [_encoder((" ".join(w) + " ").encode()) for w in self.words]
        self.sizes: dict[int, list[int]] = {}
        for i, w in enumerate(self.words):
            self.sizes.setdefault(1 << max(3, (len(w) - 1).bit_length()), []).append(i)
        self.own = [max(1, len(self.plain.compress(_raw(w))) - len(e.compress(_raw(w)))) for w, e in zip(self.words, self.given)]
        self.seeds: list[dict[tuple, list[int]]] = []
        for w in self.words:
            at: dict[tuple, list[int]] = {}
            for i in range(len(w) - SEED + 1):
                at.setdefault(tuple(w[i : i + SEED]), []).append(i)
            self.seeds.append(at)

    def blocks(self, text: list[str]) -> Iterator[tuple[int, int, int]]:
        """(size, from, to) of the blocks of a text's words: stretches in reach of mentions, long ones in overlapping parts."""
        mentions = [i for i, w in enumerate(text) if MENTIONS.search(w)]
        for size in self.sizes:
            stretch = None
            for m in mentions:
                a, b = max(0, m - size), min(len(text), m + size + 1)
                if stretch and a <= stretch[1]:
                    stretch = (stretch[0], b)
                    continue
                if stretch:
                    yield from self._parts(size, *stretch)
                stretch = (a, b)
            if stretch:
                yield from self._parts(size, *stretch)

    @staticmethod
    def _parts(size: int, a: int, b: int) -> Iterator[tuple[int, int, int]]:
        while b - a > 4 * size:  # a template lies in one part at least
            yield size, a, a + 3 * size
            a += size
        yield size, a, b

    def rank(self, block: list[str], size: int) -> list[tuple[float, int]]:
        """(saved bytes over what the template saves on itself, template) of templates of a size that save enough, the largest share first."""
        raw = _raw(block)
        alone = len(self.plain.compress(raw))
        saved = [((alone - len(self.given[i].compress(raw))) / self.own[i], i) for i in self.sizes[size]]
        return sorted((x for x in saved if x[0] >= SAVED), key=lambda x: (-x[0], x[1]))

    def places(self, block: list[str], template: int) -> Iterator[int]:
        """Where in a block the template might begin: diagonals on which both have SEED words in a row, near ones once."""
        seeds, slack = self.seeds[template], 1 + len(self.words[template]) // 5
        found = sorted({j - i for j in range(len(block) - SEED + 1) for i in seeds.get(tuple(block[j : j + SEED]), ())})
        last = None
        for d in found:
            if last is None or d - last > slack:
                yield d
                last = d

    def differences(self, block: list[str], template: int, around: int) -> tuple[float, list[str], list[str], int, int]:
        """(share of words alike, words the block lacks, words it adds, from, to) for the template laid at about ``around``."""
        own = self.words[template]
        slack = 1 + len(own) // 5
        low = max(0, around - slack)
        part = block[low : max(0, around + len(own) + 2 * slack)]
        inside = [m for m in SequenceMatcher(None, own, part, autojunk=False).get_matching_blocks() if m.size]
        if not inside:
            return 0.0, own, [], 0, 0
        begin, end = inside[0].b, inside[-1].b + inside[-1].size
        lack, add, at_own, at_part = [], [], 0, begin
        for m in inside:
            lack += own[at_own : m.a]
            add += part[at_part : m.b]
            at_own, at_part = m.a + m.size, m.b + m.size
        lack += own[at_own:]
        same = sum(m.size for m in inside)
        return 2 * same / (len(own) + end - begin), lack, add, low + begin, low + end

    def scan(self, text: str | None) -> list[tuple]:
        """(line, license, reduction, alike, lacks, adds) of every confirmed place of a text, in order; of those that overlap the longest, then most alike one."""
        if not text:
            return []
        spans = list(_WORD.finditer(text.lower()))
        have = [_SPELLING.get(m[0], m[0]) for m in spans]
        places = {}
        for size, a, b in self.blocks(have):
            block = have[a:b]
            for share, i in self.rank(block, size):
                for around in self.places(block, i):
                    alike, lack, add, begin, end = self.differences(block, i, around)
                    telling = [w for w in lack + add if w in TELLING or w[0].isdigit()]
                    if alike >= ALIKE and not telling:
                        places.setdefault((-(end - begin - len(add)), -alike, -share, i, a + begin, a + end), (lack, add))
        taken: list[tuple[int, int]] = []
        out = []
        for key in sorted(places):
            _, alike, share, i, begin, end = key
            if any(begin < y and x < end for x, y in taken):
                continue
            taken.append((begin, end))
            if not self._denied(text, spans, have, begin):
                out.append((begin, (text.count("\n", 0, spans[begin].start()), self.names[i], min(1.0, -share), -alike, *places[key])))
        return [row for _, row in sorted(out, key=lambda x: x[0])]

    def _denied(self, text: str, spans: list, have: list[str], begin: int) -> bool:
        """Does a word before the place deny it, in the same sentence?"""
        for k in range(begin - 1, max(-1, begin - 1 - REACH), -1):
            if _STOP.search(text, spans[k].end(), spans[k + 1].start() + 1):
                return False
            if have[k] in DENIAL:
                return True
        return False


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("line", pa.int32()), ("license", pa.string()), ("reduction", pa.float64()), ("alike", pa.float64()), ("lacks", pa.list_(pa.string())), ("adds", pa.list_(pa.string()))])


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """doc_id, line, license, reduction, alike, lacks and adds: one row per place of docs (doc_id, text) that a template confirms.

    The whole text is scanned, whatever its lines.  line is the one on which the place begins, from 0; reduction is what the
    template saves as dictionary, as a share of what it saves on itself (at most 1).  Null and empty texts give no row, repeated rows give
    theirs each time, an empty table gives an empty result, other columns are ignored.
    Of places that overlap, the longest wins, then the most alike, then the larger reduction, then the earlier template.  A
    place with a denial before it in its sentence is none.
    """
    given = TEMPLATES if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(given)
        for batch in slices(batches):
            rows = [(i, *r) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for r in scanner.scan(t)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _SCHEMA.types)], schema=_SCHEMA)

    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return named.mapInArrow(run, "doc_id long, line int, license string, reduction double, alike double, lacks array<string>, adds array<string>")
