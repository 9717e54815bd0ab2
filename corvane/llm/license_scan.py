"""License notices found by conditional compression.

Candidate blocks are stretches of words as wide as the templates ask for, wherever a word of a template
stands that no confirmed notice can do without. They are compressed with zstandard in lower case, alone
and with each template as a raw dictionary, where the block has enough of the template's words. What
they save ranks the templates; one that saves less than LEAST_SHARE of what it saves on its own wording
is out. The winners are confirmed in that order by the exact differences of wording, each inside what
the winners before it have left of the block.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass
from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import nothing_held, table

# Notices by license, as they are commonly worded.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "BSD-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "ISC-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "GPL-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "BSD-2-Clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-3-Clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "Zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}
#: Most differing words per word of the template.
DIFFERENT = 0.15
#: The least share of its own saving at which a template is confirmed. In 1,283 notices with up to 15 % of their words changed the least was 0.39.
LEAST_SHARE = 0.2
#: Bytes that a template must save on its own wording for its savings to tell anything; shorter ones are confirmed whatever they save.
TELLING = 12
#: Words of the narrowest blocks. Longer templates have blocks of this times the power of two that holds their longest notice twice.
NARROWEST = 16
_WORD = re.compile(r"[A-Za-z0-9À-ɏ]+(?:[.'/-][A-Za-z0-9À-ɏ]+)*")
COLUMNS = "start long, stop long, license string, saved_share double, differing int, exact boolean"


@dataclass
class Template:
    name: str
    words: list[str]
    given: object
    own_saving: int
    marks: frozenset
    width: int

    @property
    def most(self) -> int:
        """Words that may differ."""
        return int(DIFFERENT * len(self.words))


def marks_of(words: list[str], shared: dict[str, int]) -> frozenset:
    """Words of a template of which any confirmed notice has one: more of them than may differ, those of many templates and long ones first."""
    need, out = int(DIFFERENT * len(words)) + 1, set()
    for w in sorted(set(words), key=lambda w: (any(c.isdigit() for c in w), len(w) < 6, -shared[w], -len(w), w)):
        if sum(x in out for x in words) >= need:
            break
        out.add(w)
    return frozenset(out)


class Scanner:
    def __init__(self, templates: dict[str, str]):
        import ahocorasick
        import zstandard as z

        self.plain = z.ZstdCompressor(level=19, write_content_size=False)
        wordings = {name: words_of(text) for name, text in templates.items()}
        shared: dict[str, int] = {}
        for words in wordings.values():
            for w in set(words):
                shared[w] = shared.get(w, 0) + 1
        self.templates: list[Template] = []
        self.trigger = ahocorasick.Automaton()
        for name, words in wordings.items():
            if not words:
                continue
            raw = templates[name].lower().encode()
            given = z.ZstdCompressor(level=19, write_content_size=False, dict_data=z.ZstdCompressionDict(raw, dict_type=z.DICT_TYPE_RAWCONTENT))
            saving = len(self.plain.compress(raw)) - len(given.compress(raw))
            width, longest = NARROWEST, len(words) + int(DIFFERENT * len(words))
            while width < 2 * longest:  # so that some block, half a width after another, holds all of a notice with words put in
                width *= 2
            self.templates.append(Template(name, words, given, max(1, saving), marks_of(words, shared), width))
            for w in self.templates[-1].marks:
                self.trigger.add_word(w, w)
        if self.templates:
            self.trigger.make_automaton()

    def marked(self, text: str) -> bool:
        """Whether any template's mark stands in the text."""
        return bool(self.templates) and next(self.trigger.iter(text.lower()), None) is not None

    def blocks(self, words: list[str]):
        """(start, stop, templates) of candidate blocks, in words: stretches of each width, half a width apart, with a mark of these templates."""
        for width in sorted({t.width for t in self.templates}):
            own = [t for t in self.templates if t.width == width]
            marks = frozenset().union(*(t.marks for t in own))
            hot = [i for i, w in enumerate(words) if w in marks]
            for at in range(0, max(1, len(words) - width // 2), width // 2):
                stop = min(at + width, len(words))
                if (k := bisect_left(hot, at)) < len(hot) and hot[k] < stop:
                    yield at, stop, own

    def scan(self, text: str | None) -> list[tuple]:
        """(start, stop, license, saved share, differing words, exact) of confirmed notices, by place. Of two that
        overlap that of more agreeing words stays, then that of fewer differing ones."""
        if not text or not self.marked(text):
            return []
        places = [(m[0].lower(), m.start(), m.end()) for m in _WORD.finditer(text)]
        words = [w for w, *_ in places]
        found = set()
        for start, stop, own in self.blocks(words):
            there = set(words[start:stop])
            # A word of the template that the block lacks differs, so the others can't be confirmed.
            able = [t for t in own if not t.marks.isdisjoint(there) and sum(w not in there for w in t.words) <= t.most]
            if not able:
                continue
            raw = text[places[start][1] : places[stop - 1][2]].lower().encode()
            plain = len(self.plain.compress(raw))
            ranked = [(plain - len(t.given.compress(raw)), t) for t in able]
            open_ = [(start, stop)]  # what no winner has taken
            for saving, t in sorted(ranked, key=lambda r: (-r[0], r[1].name)):
                share = saving / t.own_saving
                if t.own_saving >= TELLING and share < LEAST_SHARE:
                    continue  # the dictionary hardly helped: its wording isn't here
                left, open_ = open_, []
                while left:  # a block may hold the notice again
                    a, b = left.pop()
                    if b - a < len(t.words) - t.most or (hit := self.confirm(t, words[a:b])) is None:
                        open_.append((a, b))
                        continue
                    first, last, differing = a + hit[0], a + hit[1], hit[2]
                    found.add((len(t.words) - differing, places[first][1], places[last][2], t.name, round(share, 6), differing, differing == 0))
                    left += [(a, first), (last + 1, b)]
        kept: list[tuple] = []
        ends: list[tuple] = []  # spans that are taken, ascending
        for _, *r in sorted(found, key=lambda r: (-r[0], r[5], r[2] - r[1], r[1], -r[4], r[3])):
            k = bisect_left(ends, (r[0], r[1]))
            if (k == 0 or ends[k - 1][1] <= r[0]) and (k == len(ends) or ends[k][0] >= r[1]):
                ends.insert(k, (r[0], r[1]))
                kept.append(tuple(r))
        return sorted(kept)

    @staticmethod
    def confirm(t: Template, words: list[str]) -> tuple[int, int, int] | None:
        """First and last word of the stretch that follows the template, and the words that differ; None if too many do, or a number."""
        same = [(i, j, n) for i, j, n in SequenceMatcher(None, t.words, words, autojunk=False).get_matching_blocks() if n]
        if not same:
            return None
        # Runs of agreeing words are strung together where that costs less than to leave out the template's words before them.
        best: list[tuple] = []
        for x, (i, j, _) in enumerate(same):
            options = [(i, -1)]
            for y in range(x):
                pi, pj, pn = same[y]
                options.append((best[y][0] + max(i - pi - pn, j - pj - pn), y))
            best.append(min(options))
        end = min(range(len(same)), key=lambda x: best[x][0] + len(t.words) - same[x][0] - same[x][2])
        differing = best[end][0] + len(t.words) - same[end][0] - same[end][2]
        if differing > t.most:
            return None
        kept, chain, x = set(), [], end
        while x >= 0:
            chain.append(same[x])
            kept.update(range(same[x][0], same[x][0] + same[x][2]))
            x = best[x][1]
        if any(any(c.isdigit() for c in w) for k, w in enumerate(t.words) if k not in kept):
            return None
        return chain[-1][1], chain[0][1] + chain[0][2] - 1, differing


def words_of(text: str) -> list[str]:
    return [m[0].lower() for m in _WORD.finditer(text)]


@lru_cache(maxsize=2)
def _scanner(items: tuple) -> Scanner:
    return Scanner(dict(items))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None) -> DataFrame:
    """A row for each notice found in a whole text: id, start and stop (characters), license, saved_share
    (of the template's own saving), differing (words) and exact.

    Blocks are as wide as the templates ask for and pay no heed to lines or paragraphs. Texts without a
    template's mark are left at once; null and empty ones give no rows, as do templates without words.
    Repeated rows give their notices each; null ids pass through, ids are of any type; other columns are
    not read; an empty table gives none.
    """
    items = tuple((TEMPLATES if templates is None else templates).items())
    slim = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))

    def run(batches):
        nothing_held()
        scanner = _scanner(items)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.bool_()]
        names = ["__id", "start", "stop", "license", "saved_share", "differing", "exact"]
        for batch in batches:
            rows, places = [], []
            for i in range(batch.num_rows):
                own = scanner.scan(batch.column(1)[i].as_py())
                rows += own
                places += [i] * len(own)
            if rows:
                columns = [pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(places)), *columns], names)

    return slim.mapInArrow(run, f"__id {dict(slim.dtypes)['__id']}, {COLUMNS}").withColumnRenamed("__id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


QUERIES = {"op6_license_scan": query}
SQL: dict[str, str] = {}
