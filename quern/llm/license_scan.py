"""License scans: normalised text against license templates by Dice over word bigrams.

Text is normalised as license matchers do: case, punctuation and layout go. A
passage is any run of words; it and a template agree by the Dice coefficient of
their bigram multisets. Dice of at least T needs sizes within T / (2 - T) of
each other, which prunes templates for a passage and passages for a template:
a template is compared only where a stretch of its largest admissible size
holds as many of its bigrams as its least admissible one. So a notice is found
inside a longer line and across paragraphs.

For a template, each start has its best end, that of the highest
2 c * c / (n + m) (c bigrams of n and m are common: Dice weighed by what is
common, so a whole license goes before a notice inside it). Passages are taken
from the highest such value down, if they overlap none taken before.

Edge cases: a null or empty text has no passages and no match; a passage of one
word has no bigrams and matches nothing; equal values go to the earlier start,
then to the first template by name, then to the shorter passage; very long
texts are matched whole; repeated rows are matched each; an empty table gives
an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import kept, spread

#: Least Dice coefficient of a match.
DICE = 0.8

_GNU = (
    "This {thing} is free software; you can redistribute it and/or modify it under the terms of the GNU {name} General Public License as published by "
    "the Free Software Foundation; either version {version} of the License, or (at your option) any later version. This {thing} is distributed in the "
    "hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See "
    "the GNU {name} General Public License for more details. You should have received a copy of the GNU {name} General Public License along with this "
    "{thing}; if not, see https://www.gnu.org/licenses/."
)


def _gnu(name: str, version: str, thing: str = "program") -> str:
    return _GNU.format(thing=thing, name=name, version=version)


_WARRANTY_MIT = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS "
    "IN THE SOFTWARE."
)
_BSD_TERMS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution. "
)
_BSD_NAMES = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission. "
)
_BSD_WARRANTY = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE '
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE "
    "LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
    "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
    "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH "
    "DAMAGE."
)
_ISC_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
    "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
    "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_PERMISSION = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"

# Notices by which texts state their license, and license texts.
TEMPLATES = {
    "0BSD-text": f"{_PERMISSION}. {_ISC_WARRANTY}",
    "AGPL-3.0-notice": _gnu("Affero", "3"),
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "BSD-2-Clause-text": _BSD_TERMS + _BSD_WARRANTY,
    "BSD-3-Clause": "Licensed under the 3-Clause BSD License.",
    "BSD-3-Clause-text": _BSD_TERMS + _BSD_NAMES + _BSD_WARRANTY,
    "BSL-1.0-text": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by "
        'this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the '
        "Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software "
        "and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the "
        "Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of "
        "machine-executable object code generated by a source language processor. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
        "FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE "
        "FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR "
        "OTHER DEALINGS IN THE SOFTWARE."
    ),
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-4.0-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0-notice": (
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain "
        "worldwide. This software is distributed without any warranty."
    ),
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-2.0-notice": _gnu("", "2"),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": _gnu("", "3"),
    "ISC-text": f"{_PERMISSION}, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_WARRANTY}",
    "LGPL-2.1-notice": _gnu("Lesser", "2.1", "library"),
    "LGPL-3.0-notice": _gnu("Lesser", "3"),
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _WARRANTY_MIT
    ),
    "MPL-2.0-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can "
        "obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "Unlicense-text": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this "
        "software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that "
        "recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make "
        "this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act "
        "of relinquishment in perpetuity of all present and future rights to this software under copyright law. " + _WARRANTY_MIT
    ),
    "Zlib-text": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from "
        "the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and "
        "redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you "
        "wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not "
        "required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may "
        "not be removed or altered from any source distribution."
    ),
}
_WORD = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")


def normalised_words(text: str) -> list[str]:
    return _WORD.findall(text.lower().replace("licence", "license"))


class Matcher:
    """Bigrams of all templates, and the ones that hold each."""

    def __init__(self, templates: dict[str, str], least: float = DICE) -> None:
        self.least, self.ratio = least, least / (2 - least)
        self.names = sorted(templates)
        grams = [Counter(zip(w, w[1:])) for w in (normalised_words(templates[n]) for n in self.names)]
        self.grams, self.sizes = grams, [sum(g.values()) for g in grams]
        self.owners: dict[tuple[str, str], list[int]] = {}
        for t, g in enumerate(grams):
            for gram in g:
                self.owners.setdefault(gram, []).append(t)

    def passages(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """(template, Dice, first word, past the last word) of the passages that match, in the order they are taken."""
        words = normalised_words(text or "")
        owners = self.owners
        hits: dict[int, list[int]] = {}
        for i, gram in enumerate(zip(words, words[1:])):
            if gram in owners:
                for t in owners[gram]:
                    hits.setdefault(t, []).append(i)
        found = []
        for t, at in hits.items():
            if len(at) >= self.ratio * self.sizes[t] - 1e-9:
                found += self._ends(words, t, at)
        taken: list[tuple[str, float, int, int]] = []
        busy = bytearray(len(words)) if found else b""
        for _, start, t, end, dice in sorted(found):
            if not any(busy[start:end]):
                busy[start:end] = b"\1" * (end - start)
                taken.append((self.names[t], dice, start, end))
        return taken

    def _ends(self, words: list[str], t: int, at: list[int]):
        """(-value, start, template, end, Dice) for the best end of each start; passages begin and end with a bigram of the template."""
        m, grams, least = self.sizes[t], self.grams[t], self.ratio * self.sizes[t] - 1e-9
        # A bigram counts in a passage if fewer than the template's number of it lie between the start and it.
        seen: dict[tuple[str, str], list[int]] = {}
        back = np.full(len(at), -1)
        for k, p in enumerate(at):
            same = seen.setdefault((words[p], words[p + 1]), [])
            same.append(k)
            most = grams[words[p], words[p + 1]]
            if len(same) > most:
                back[k] = same[-1 - most]
        where = np.array(at)
        last = np.searchsorted(where, where + int(m / self.ratio + 1e-9))
        for i in np.nonzero(last - np.arange(len(at)) >= least)[0].tolist():
            common = np.cumsum(back[i : last[i]] < i)
            both = where[i : last[i]] - (at[i] - 1 - m)
            dice = 2 * common / both
            value = np.where(dice >= self.least, 2 * common * common / both, 0.0)
            k = int(value.argmax())
            if value[k] > 0:
                yield -float(value[k]), at[i], t, at[i + k] + 2, float(dice[k])

    def licenses(self, text: str | None) -> list[tuple[str, float, int]]:
        """(template, best Dice, passages that match it) for a text, best first."""
        found: dict[str, list] = {}
        for name, dice, _, _ in self.passages(text):
            entry = found.setdefault(name, [0.0, 0])
            entry[0], entry[1] = max(entry[0], dice), entry[1] + 1
        return sorted(((n, d, c) for n, (d, c) in found.items()), key=lambda x: (-x[1], x[0]))


MATCHES = "array<struct<license string, dice double, passages int>>"
_MATCHES_ARROW = pa.list_(pa.struct([("license", pa.string()), ("dice", pa.float64()), ("passages", pa.int32())]))


def _scan(batches, templates: dict[str, str], least: float):
    matcher = kept(("licenses", least, *templates.items()), lambda: Matcher(templates, least))
    for b in batches:
        texts = b.column(1)
        out = [[{"license": n, "dice": d, "passages": c} for n, d, c in matcher.licenses(texts[i].as_py())] for i in range(len(texts))]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, type=_MATCHES_ARROW)], names=["doc_id", "matches"])


def scan_licenses(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", templates: dict[str, str] | None = None, least: float = DICE) -> DataFrame:
    """Rows (doc_id, matches), one per row of the input. templates: name -> text, instead of TEMPLATES."""
    dtype = dict(docs.dtypes)[id_col]
    known = TEMPLATES if templates is None else templates
    return spread(docs.select(f"`{id_col}`", f"`{text_col}`")).mapInArrow(lambda bs: _scan(bs, known, least), f"doc_id {dtype}, matches {MATCHES}")
