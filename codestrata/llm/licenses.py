"""Operator 2: license scans by MinHash bands over overlapping text windows.

For a template of m shingles, windows of m shingles start at every max(1, m // 8)-th place and at the last. Signatures have BANDS
bands of one row, so a window with similarity s is retrieved with probability 1 - (1 - s)^BANDS. A place that holds
0.8 of a template has a window with s >= 0.6 even in the worst alignment: 0.9993. Retrieved windows are verified by
the exact share of the template's shingles that they contain.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame

from .common import hashes_of, over_rows, shingles

BANDS = 8
LEAST = 0.8
K = 5
_TOKEN = re.compile(r"\w+(?:[.\-]\w+)*")

def _gnu(kind: str, version: str, later: str = "or (at your option) any later version.") -> list[str]:
    """The notice of a GNU license for a program: its grant, and its disclaimer with the pointer to the license."""
    subject = "library" if "Lesser" in kind else "program"
    return [
        f"This {subject} is free software; you can redistribute it and/or modify it under the terms of the {kind} as published by the Free Software Foundation; either version {version} of the License, {later}",
        f"This {subject} is free software; you can redistribute it and/or modify it under the terms of the {kind} as published by the Free Software Foundation; either version {version} of the License, {later} This {subject} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {kind} for more details.",
    ]


def _creative_commons(code: str, name: str) -> list[str]:
    return [f"Licensed under CC {code} 4.0.", f"This work is licensed under a Creative Commons {name} 4.0 International License."]


_BSD_OPENING = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_BSD_2 = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."

#: Notices as their licenses word them. What two licenses share word for word is named as either of them.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "GPL-2.0": _gnu("GNU General Public License", "2"),
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or at your option any later version.",
        _gnu("GNU General Public License", "3")[1],
    ],
    "LGPL-2.1": _gnu("GNU Lesser General Public License", "2.1"),
    "LGPL-3.0": _gnu("GNU Lesser General Public License", "3"),
    "AGPL-3.0": _gnu("GNU Affero General Public License", "3"),
    "CC-BY-4.0": _creative_commons("BY", "Attribution"),
    "CC-BY-SA-4.0": _creative_commons("BY-SA", "Attribution-ShareAlike"),
    "CC-BY-ND-4.0": _creative_commons("BY-ND", "Attribution-NoDerivatives"),
    "CC-BY-NC-4.0": _creative_commons("BY-NC", "Attribution-NonCommercial"),
    "CC-BY-NC-SA-4.0": _creative_commons("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
    "CC-BY-NC-ND-4.0": _creative_commons("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
    "BSD-2-Clause OR BSD-3-Clause": [_BSD_OPENING],
    "BSD-2-Clause": [f"{_BSD_OPENING}: 1. {_BSD_2} {_BSD_END}"],
    "BSD-3-Clause": [f"{_BSD_OPENING}: 1. {_BSD_2} {_BSD_3} {_BSD_END}"],
    "Unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
}


def words(text: str | None) -> list[str]:
    return _TOKEN.findall((text or "").lower())


def _functions() -> np.ndarray:
    return np.random.default_rng(5).integers(0, 1 << 63, BANDS, np.uint64) * np.uint64(2) + np.uint64(1)


def best_placed(found: list[tuple]) -> list[tuple]:
    """Of places that overlap by half of the shorter the one that holds most shingles, of equals the largest share."""
    kept: list[tuple] = []
    for r in sorted(found, key=lambda r: (-r[5], -r[4], r[2], r[0], r[1])):
        if all(2 * (min(r[3], x[3]) - max(r[2], x[2])) < min(r[3] - r[2], x[3] - x[2]) for x in kept):
            kept.append(r)
    return kept


class Scanner:
    def __init__(self, templates: dict[str, list[str]]):
        self.by = _functions()
        self.groups: dict[int, list] = {}
        for name, texts in sorted(templates.items()):
            for part, text in enumerate(texts):
                w = words(text)
                if len(w) < K:
                    raise ValueError(f"a template needs {K} words: {text!r}")
                s = shingles(hashes_of(w), K)
                self.groups.setdefault(len(s), []).append((name, part, len(w), np.unique(s), (self.by[:, None] * s).min(1)))

    def scan(self, text: str | None) -> list[tuple[str, int, int, int, float]]:
        """(license, part, first word, end, contained share), places of one part apart from each other."""
        w = words(text)
        out: list = []
        if len(w) < K:
            return out
        s = shingles(hashes_of(w), K)
        least, size = self.by[:, None] * s, 1  # least of each `size` shingles: doubled on the way, once for all groups
        for m, group in sorted(self.groups.items()):
            step, width = max(1, m // 8), min(m, len(s))
            while 2 * size <= width:
                least, size = np.minimum(least[:, :-size], least[:, size:]), 2 * size
            places = np.unique(np.append(np.arange(0, len(s) - width + 1, step), len(s) - width))  # the last window too
            mins = np.minimum(least[:, places], least[:, places + width - size])
            for name, part, length, own, wanted in group:
                hit = (mins == wanted[:, None]).any(0)
                best: list = []
                for at in places[hit].tolist():
                    for a in range(max(0, at - step), min(at + step, max(0, len(s) - m)) + 1):  # each alignment near it
                        share = np.isin(own, s[a : a + m]).sum() / len(own)
                        if share >= LEAST:
                            best.append((-share, a))
                taken: list[int] = []
                for share, a in sorted(set(best)):
                    if all(abs(a - b) >= m for b in taken):
                        taken.append(a)
                        out.append((name, part, a, min(a + length, len(w)), -share, round(-share * len(own))))
        return sorted((r[:5] for r in best_placed(out)), key=lambda r: (r[2], r[0], r[1]))


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """(doc_id, license, part, start, end, share): every place of every whole text that holds at least LEAST of a
    template's shingles, of overlapping ones the best; start and end count words. One narrow pass; the templates, a constant, go with the task.

    Null, empty and short texts have no places; a text that holds a template twice has two rows; repeated rows are
    scanned each; a null doc_id is returned as such.
    """
    chosen = TEMPLATES if templates is None else templates

    def make():
        scanner = Scanner(chosen)

        def work(doc_id, text):
            rows = [(d, *r) for d, t in zip(doc_id, text) for r in scanner.scan(t)]
            return dict(zip(["doc_id", "license", "part", "start", "end", "share"], zip(*rows))) if rows else None

        return work

    return over_rows(docs, ["doc_id", "text"], "doc_id bigint, license string, part int, start int, end int, share double", make)
