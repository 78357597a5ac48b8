"""Operator 9, license scans by conditional compression.

Blocks around telltale words are compressed by zstandard with each template as raw dictionary; templates are ranked by
how much smaller than alone the block becomes, and every template that makes it smaller is confirmed or refused by the
exact words in which block and template differ.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, slices

#: Least share of a template's words that a block must have, in order; extra words allowed; words up to which a notice must be whole.
LEAST_SHARE, MOST_EXTRA, WHOLE = 0.9, 0.25, 12
#: Words that make a block a candidate (fixed values); every template has one.
TELLTALE = ("license", "licensed", "licence", "lizenz", "copyright", "permission", "warranty", "redistribution", "redistribute", "waived", "unencumbered", "unlicense", "spdx-license-identifier")

#: Identifiers of SPDX tags.
IDENTIFIERS = (
    "0BSD AFL-3.0 AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSD-4-Clause BSL-1.0 CC-BY-4.0 CC-BY-SA-4.0 "
    "CC-BY-NC-4.0 CC0-1.0 CDDL-1.0 ECL-2.0 EPL-1.0 EPL-2.0 EUPL-1.2 GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1 "
    "LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL NCSA OFL-1.1 OpenSSL PostgreSQL Python-2.0 Ruby "
    "Unlicense UPL-1.0 Vim W3C WTFPL X11 Zlib"
).split()

#: What notices call a license, by identifier, and the forms of such notices.
NAMES = {
    "MIT": ["MIT License", "MIT license (MIT)", "MIT"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0", "Apache Software License 2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-Clause BSD License", "New BSD License"],
    "ISC": ["ISC License"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License v2.0", "GNU GPL version 2", "GPL v2", "GPLv2"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPL version 3", "GPL v3", "GPLv3"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "LGPL v2.1", "LGPLv2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "LGPL v3", "LGPLv3"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU AGPL version 3", "AGPL v3", "AGPLv3"],
    "MPL-2.0": ["Mozilla Public License, v. 2.0", "Mozilla Public License 2.0", "MPL 2.0"],
    "EPL-2.0": ["Eclipse Public License 2.0", "Eclipse Public License - v 2.0"],
    "BSL-1.0": ["Boost Software License, Version 1.0", "Boost Software License 1.0"],
    "Zlib": ["zlib License"],
    "Unlicense": ["Unlicense"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "CC-BY-NC-SA-4.0": ["CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
    "CC-BY-NC-ND-4.0": ["CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"],
}
FORMS = ["Licensed under the {}", "Licensed under {}", "Licensed under a {}", "License: {}", "Lizenz: {}"]
#: Forms that only names with a telltale word of their own can have.
OWN_FORMS = ["{}", "Released under the {}"]

#: Public texts and headers.
TEXTS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission
notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT
WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES
OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "MIT/grant": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions:""",
    "MIT/warranty": """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED
"AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE
OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "ISC/grant": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this
list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING,
BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this
list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND
CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.""",
    "BSD/grant": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met:""",
    "Apache-2.0/header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
governing permissions and limitations under the License.""",
    "BSL-1.0": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software
and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and
transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is
furnished to do so, all subject to the following:""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any
purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
restrictions:""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
purpose, commercial or non-commercial, and by any means.""",
    "Unlicense/notice": "This is free and unencumbered software released into the public domain.",
    "MPL-2.0/header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL
was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "CC0-1.0": """To the extent possible under law, the author has waived all copyright and related or neighboring rights to this
work.""",
    "WTFPL": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE",
    "GPL-2.0/title": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "GPL-3.0/title": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "LGPL-3.0/title": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "AGPL-3.0/title": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "Apache-2.0/title": "Apache License Version 2.0, January 2004",
    "MPL-2.0/title": "Mozilla Public License Version 2.0",
    "BSL-1.0/title": "Boost Software License - Version 1.0 - August 17th, 2003",
}
#: Fixed value: the header of the GNU licenses, by name and version.
GNU_HEADER = (
    "This {} is free software; you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free "
    "Software Foundation; either version {} of the License, or (at your option) any later version."
)
GNU = {"GPL": ("program", "General Public License", ("2", "3")), "LGPL": ("library", "Lesser General Public License", ("2.1", "3")), "AGPL": ("program", "Affero General Public License", ("3",))}

_find_words = re.compile(WORD).finditer


def _fold(word: str) -> str:
    """Wording without case and punctuation at its ends; a word of punctuation only stays."""
    return re.sub(r"^\W+|\W+$", "", word.lower()) or word.lower()


def _folded(text: str) -> list[str]:
    return [_fold(m[0]) for m in _find_words(text)]


def templates() -> dict[str, str]:
    """Every template by name: a license's identifier, and behind a slash which of its wordings it is."""
    out = dict(TEXTS)
    for family, (thing, name, versions) in GNU.items():
        out |= {f"{family}-{v if '.' in v else v + '.0'}-or-later/header": GNU_HEADER.format(thing, name, v) for v in versions}
    for license_, names in NAMES.items():
        for name in names:
            forms = FORMS + (OWN_FORMS if "license" in name.lower() else [])
            out |= {f"{license_}/{form.format(name).lower()}": form.format(name) for form in forms}
    return out | {f"{i}/spdx": f"SPDX-License-Identifier: {i}" for i in IDENTIFIERS}


class Scanner:
    def __init__(self, named: dict[str, str]):
        different: dict[tuple[str, ...], str] = {}
        for name, text in named.items():
            different.setdefault(tuple(_folded(text)), name)
        self.names, self.words = list(different.values()), [list(ws) for ws in different]
        self.bags = [Counter(ws) for ws in self.words]
        self.at: dict[str, list[tuple[int, int]]] = {}  # telltale word -> templates and where they have it
        for k, ws in enumerate(self.words):
            for i, w in enumerate(ws):
                if w in TELLTALE:
                    self.at.setdefault(w, []).append((k, i))
        raw = zstandard.DICT_TYPE_RAWCONTENT
        self.with_template = [zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(" ".join(ws).encode(), dict_type=raw)) for ws in self.words]
        self.alone = zstandard.ZstdCompressor(level=3)

    def scan(self, text: str) -> list[tuple[str, int, int, int, list[str], list[str]]]:
        """(template, start, end, bytes saved, missing words, extra words): start and end in characters. Of findings
        that overlap, the one stays that explains most words, less those in which it differs."""
        spans = list(_find_words(text))
        words = [_fold(m[0]) for m in spans]
        best, blocks = [], {}
        for t, w in enumerate(words):
            for k, offset in self.at.get(w, ()):
                low = max(0, t - offset)
                blocks.setdefault((low, min(len(words), low + len(self.words[k]))), set()).add(k)
        for (low, high), ks in sorted(blocks.items()):
            block = " ".join(words[low:high]).encode()
            size = len(self.alone.compress(block))
            ranked = sorted((len(self.with_template[k].compress(block)) - size, k) for k in ks if self._may_hold(k, words, low, high))
            for more, k in ranked:
                if more >= 0:
                    break
                found = self._confirm(k, words, low, high)
                if found:
                    first, last, missing, extra = found
                    best.append((len(self.words[k]) - 2 * len(missing) - len(extra), -more, self.names[k], first, last, missing, extra))
        out: list[tuple] = []
        for _, saved, name, first, last, missing, extra in sorted(best, key=lambda b: (-b[0], -b[1], b[2], b[3])):
            if all(last < a or first > b for _, a, b, *_ in out):
                out.append((name, first, last, saved, missing, extra))
        return [(name, spans[a].start(), spans[b].end(), saved, missing, extra) for name, a, b, saved, missing, extra in sorted(out, key=lambda o: o[1])]

    def _around(self, k: int, words: list[str], low: int, high: int) -> tuple[int, int]:
        slack = max(2, int(MOST_EXTRA * len(self.words[k])))
        return max(0, low - slack), min(len(words), high + slack)

    def _may_hold(self, k: int, words: list[str], low: int, high: int) -> bool:
        """Whether enough of the template's words stand near the block, in any order."""
        low, high = self._around(k, words, low, high)
        least = len(self.words[k]) if len(self.words[k]) <= WHOLE else LEAST_SHARE * len(self.words[k])
        return (self.bags[k] & Counter(words[low:high])).total() >= least

    def _confirm(self, k: int, words: list[str], low: int, high: int):
        """(first, last, missing, extra) if the block has enough of the template's words and every number of it."""
        template = self.words[k]
        low, high = self._around(k, words, low, high)
        block = words[low:high]
        steps = [m for m in SequenceMatcher(None, template, block, autojunk=False).get_matching_blocks() if m.size]
        if not steps:
            return None
        first, last = steps[0].b, steps[-1].b + steps[-1].size - 1
        have = sum(m.size for m in steps)
        covered = {i for m in steps for i in range(m.a, m.a + m.size)}
        missing = [w for i, w in enumerate(template) if i not in covered]
        used = {i for m in steps for i in range(m.b, m.b + m.size)}
        extra = [w for i, w in enumerate(block[first : last + 1], first) if i not in used]
        telling = [w for w in missing if re.search(r"\d", w) or len(template) <= WHOLE]  # a short notice or a version must be whole
        if have < LEAST_SHARE * len(template) or len(extra) > MOST_EXTRA * len(template) or telling:
            return None
        return low + first, low + last, missing, extra


def _scan(named: dict[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(named)
        names = ["doc_id", "license", "template", "start", "end", "saved_bytes", "missing", "extra"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string())]
        for batch in batches:
            for part in slices(batch):
                texts = zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True)
                rows = [(i, f[0].split("/")[0], *f) for i, text in texts for f in scanner.scan(text)]
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kind) for j, kind in enumerate(kinds)], names)

    return run


def scan_licenses(docs: DataFrame, named: dict[str, str] | None = None) -> DataFrame:
    """doc_id, license, template, start, end (characters), saved_bytes, missing, extra: one row for each license text
    found, by the templates ``named`` (``templates()`` unless given), each of which must have a telltale word.

    Null and empty texts have none; texts of any length are scanned whole; rows that repeat a document repeat its
    findings; an empty table gives no rows. Documents without a telltale word never reach Python.
    """
    telltale = r"(?i)\b(" + "|".join(TELLTALE) + r")\b"
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).filter(F.col("text").rlike(telltale))
    schema = "doc_id long, license string, template string, start long, end long, saved_bytes long, missing array<string>, extra array<string>"
    return rows.mapInArrow(_scan(templates() if named is None else named), schema)


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "license", "template", "start", "end", "saved_bytes", F.size("missing").alias("n_missing"), F.size("extra").alias("n_extra"))
