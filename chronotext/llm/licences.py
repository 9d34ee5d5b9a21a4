"""Licence scans: sparse TF-IDF cosine of passages, lines and whole files to templates, then inheritance from the nearest directory.

Every line of a text, and the text as a whole, is a vector over its distinct words (A-Z in lower case), weighted by
tf * idf with the idf of the templates; a word of no template has the idf of a word of one template. A line or file whose
cosine to a template reaches the threshold states that licence. A first bound, the sum of the squared weights of the
template's words that stand in the line, is exact in what it leaves out, so few lines are measured in full.

Statements wrapped over lines or inside longer ones, headers and full licence texts are found as passages: all runs of as
many words as a template has, at every word of a text, line ends or not. Headers and texts are templates of their own, with
1 + ln tf in place of tf, since the common words of a long text would otherwise outweigh all others.

A file that states a licence as a whole, or whose path names a licence file, speaks for its directory. A file that
states none inherits from the nearest directory on its path that has one: distinct directories are joined with their
ancestors, the deepest wins, and files are joined with their directory.

Defined results: null and empty texts state nothing but may inherit; with a null path nothing is inherited; of several
statements the largest cosine counts, then the smaller licence name; of several licence files in one directory likewise,
then the smaller path.
"""

from __future__ import annotations

import re
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytescan
from .shared import fresh_name, join_hot, stored, tidy

#: What the letters of Creative Commons licences stand for, and the statements of them.
_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
_CC_STATEMENTS = ["Licensed under CC {short} 4.0.", "This work is licensed under the Creative Commons {long} 4.0 International License."]
#: The GNU licences by name and version, and the statement of them.
_GNU_NAMES = [("GPL-2.0", "General Public License", "2"), ("GPL-3.0", "General Public License", "3"), ("LGPL-2.1", "Lesser General Public License", "2.1"), ("LGPL-3.0", "Lesser General Public License", "3"), ("AGPL-3.0", "Affero General Public License", "3")]
_GNU_STATEMENT = "This work is licensed under the GNU {name}, version {v}."
#: Short statements by which files refer to common licences.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license."),
    *[(f"CC-{short}-4.0", said.format(short=short, long=long)) for short, long in _CC.items() for said in _CC_STATEMENTS],
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0."),
    *[(short, _GNU_STATEMENT.format(name=name, v=v)) for short, name, v in _GNU_NAMES],
    ("ISC", "Licensed under the ISC License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Zlib", "Released under the zlib License."),
]
#: Standard headers of source files, and licences as short as one. The full texts lie in licence_texts, each under its licence's name.
_GNU = "This {it} is free software; you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation; either version {v} of the License, or (at your option) any later version. This {it} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details. You should have received a copy of the GNU {name} along with this {it}; if not, "
_ADDRESS, _SITE = "write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.", "see <https://www.gnu.org/licenses/>."
HEADERS = [
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    *[(short, _GNU.format(it="library" if short.startswith("LGPL") else "program", name=name, v=v) + where) for short, name, v in _GNU_NAMES for where in (_ADDRESS, _SITE)],
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
]
#: Words that tell licences apart, those that mean the same together; words that deny.
TELLING = [["affero", "agpl"], ["lesser", "lgpl"], ["nc", "noncommercial"], ["sa", "sharealike"], ["nd", "noderivatives", "noderivs"], ["mit"], ["isc"], ["bsd"], ["apache"], ["mozilla", "mpl"], ["eclipse", "epl"], ["zlib"], ["cc0"], ["cc", "commons"]]
DENYING = ["not", "never", "no", "neither", "nor", "without", "isn", "aren", "cannot", "non"]
#: A denial counts so many words before a statement; telling words do so many around it.
BEFORE, AROUND = 3, 2


def long_templates() -> list[tuple[str, str]]:
    """Headers and full texts; read by the driver alone. The Affero licence's text is that of GPL-3.0 under the other name."""
    full = [(f.stem, f.read_text()) for f in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))]
    affero = [("AGPL-3.0", re.sub(r"(?i)GNU\s+General\s+Public\s+License", "GNU Affero General Public License", t)) for n, t in full if n == "GPL-3.0"]
    return [*HEADERS, *full, *affero]


THRESHOLD = 0.85
#: The share of a file's words that one stating line must have for the file to count as a licence file.
FILE_SHARE = 0.5
#: Columns that state() and inherit() give.
RESULTS = ("licence", "cosine", "line", "unclear", "is_licence_file", "how", "from_directory")
SPDX = re.compile(rb"SPDX-License-Identifier:[ \t]*([^\r\n]*)")
_SPDX_TOKEN = re.compile(r"[()]|[A-Za-z0-9][A-Za-z0-9.:-]*\+?")


def spdx(said: str) -> str | None:
    """The licence expression that a text begins with, in one form: AND before OR, no needless brackets. None: it begins with none.

    What follows the longest expression (the end of a comment, say) is left out.
    """
    tokens, at = [], 0
    while m := re.compile(r"[ \t]*").match(said, at):
        t = _SPDX_TOKEN.match(said, m.end())
        if t is None or (tokens and t[0] not in ("(", ")", "AND", "OR", "WITH") and tokens[-1] not in ("(", "AND", "OR", "WITH")):
            break
        tokens.append(t[0])
        at = t.end()

    def one(i: int):
        """(text, binding, end) of a licence or of brackets from token i on."""
        if i < len(tokens) and tokens[i] == "(":
            inner = some(i + 1, "OR")
            return None if inner is None or inner[2] >= len(tokens) or tokens[inner[2]] != ")" else (inner[0], inner[1], inner[2] + 1)
        if i >= len(tokens) or tokens[i] in ("(", ")", "AND", "OR", "WITH"):
            return None
        if i + 2 < len(tokens) and tokens[i + 1] == "WITH" and tokens[i + 2] not in ("(", ")", "AND", "OR", "WITH"):
            return f"{tokens[i]} WITH {tokens[i + 2]}", "", i + 3
        return tokens[i], "", i + 1

    def some(i: int, word: str):
        below = (lambda j: some(j, "AND")) if word == "OR" else one
        first = below(i)
        if first is None:
            return None
        parts, binding, end = [first], first[1], first[2]
        while end < len(tokens) and tokens[end] == word and (more := below(end + 1)) is not None:
            parts.append(more)
            end = more[2]
        if len(parts) == 1:
            return first[0], binding, end
        # an OR inside an AND keeps its brackets
        return f" {word} ".join(f"({t})" if b == "OR" and word == "AND" else t for t, b, _ in parts), word, end

    found = some(0, "OR")
    return None if found is None else found[0]


LICENCE_NAMES = r"(?i)(^|/)(licen[sc]e|copying|notice)(\.[a-z]+)?$"


class Telling:
    """What tells licences apart in a run of words: how often each of TELLING stands there, and its version numbers."""

    @staticmethod
    def _hashes(words: list[str]) -> np.ndarray:
        _, offsets, data = next(bytescan.blocks(pa.array([" ".join(words)], pa.large_string())))
        return bytescan.words(offsets, data, bytescan.ALNUM).hashes

    _known: dict[str, dict[int, int]] = {}

    @classmethod
    def _tables(cls) -> tuple[dict[int, int], dict[int, int], set[int]]:
        if not cls._known:
            flat = [(w, k) for k, words in enumerate(TELLING) for w in words]
            cls._known["terms"] = dict(zip(cls._hashes([w for w, _ in flat]).tolist(), [k for _, k in flat], strict=True))
            numbers = [str(i) for i in range(1, 10)]
            cls._known["numbers"] = dict(zip(cls._hashes(numbers).tolist(), range(1, 10), strict=True))
            cls._known["denials"] = dict.fromkeys(cls._hashes(DENYING).tolist(), 1)
        return cls._known["terms"], cls._known["numbers"], set(cls._known["denials"])

    @classmethod
    def of(cls, words: np.ndarray) -> tuple[np.ndarray, frozenset[int]]:
        terms, numbers, _ = cls._tables()
        count, found = np.zeros(len(TELLING), np.int64), set()
        for w in words.tolist():
            if w in terms:
                count[terms[w]] += 1
            elif w in numbers:
                found.add(numbers[w])
        return count, frozenset(found)

    @classmethod
    def denied(cls, words: np.ndarray) -> bool:
        return bool(cls._tables()[2] & set(words.tolist()))

    @classmethod
    def agree(cls, known: Templates, t: int, text: np.ndarray, begin: int, length: int) -> bool | None:
        """Whether a passage of a text tells the same as a template: None if it is denied.

        Of statements the terms and numbers in and around them must be the same ones; of long texts, none may stand in one of
        them many times more than in the other.
        """
        count, numbers = known.tells[t]
        if known.damped:
            own, _ = cls.of(text[begin : begin + length])
            few, many = np.minimum(own, count), np.maximum(own, count)
            return bool((many <= 2 * few + 1).all()) and (length > 200 or bool(((own[:2] > 0) == (count[:2] > 0)).all()))
        if cls.denied(text[max(0, begin - BEFORE) : begin + min(length, BEFORE)]):
            return None
        own, said = cls.of(text[max(0, begin - 1) : begin + length + AROUND])
        return bool(((own > 0) == (count > 0)).all()) and said == numbers


class Templates:
    """Template vectors over the templates' words."""

    def __init__(self, templates: list[tuple[str, str]], damped: bool = False):
        self.damped = damped
        self.names = np.array([n for n, _ in templates], object)
        text = pa.array([t for _, t in templates], pa.large_string())
        rows = []
        for _, offsets, data in bytescan.blocks(text):
            w = bytescan.words(offsets, data, bytescan.ALNUM)
            rows += [w.hashes[a:b] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
        self.vocabulary = np.unique(np.concatenate(rows))
        tf = np.stack([np.bincount(np.searchsorted(self.vocabulary, r), minlength=len(self.vocabulary)) for r in rows])
        self.idf = np.log((1 + len(rows)) / (1 + (tf > 0).sum(0))) + 1
        self.outside = float(np.log((1 + len(rows)) / 2) + 1)
        self.sizes = [len(r) for r in rows]
        self.weights = self.factor(tf) * self.idf
        self.weights /= np.linalg.norm(self.weights, axis=1, keepdims=True)

        self.tells = [Telling.of(r) for r in rows]

    def factor(self, tf: np.ndarray) -> np.ndarray:
        return np.where(tf > 0, 1 + np.log(np.maximum(tf, 1)), 0) if self.damped else tf

    def passages(self, word: np.ndarray, first: np.ndarray, threshold: float) -> list[tuple[int, int, float, int, int]]:
        """Of texts (words first[i] to first[i + 1]) and templates the best passage at or above the threshold: text,
        template, cosine, first word within the text, words. The passages are all runs of as many words as the template
        has, and the whole text."""
        at = np.minimum(np.searchsorted(self.vocabulary, word), len(self.vocabulary) - 1)
        known = self.vocabulary[at] == word
        squares, out = (self.weights**2).T.astype(np.float32), []
        for i in range(0, len(first) - 1, 256):
            part = first[i : i + 257]
            has = np.zeros((len(part) - 1, len(self.vocabulary)), np.float32)
            inside = np.flatnonzero(known[part[0] : part[-1]]) + part[0]
            has[np.searchsorted(part, inside, side="right") - 1, at[inside]] = 1
            # no passage holds more of a template's words than its text
            for d, t in np.argwhere(has @ squares >= threshold**2 - 1e-4).tolist():
                a, b = int(part[d]), int(part[d + 1])
                found = self._best_passage(word[a:b], at[a:b], known[a:b], t, threshold)
                if found is not None:
                    out.append((i + d, t, *found))
        return out

    def _cosine(self, word: np.ndarray, at: np.ndarray, known: np.ndarray, t: int) -> float:
        _, first, tf = np.unique(word, return_index=True, return_counts=True)
        weight = self.factor(tf) * np.where(known[first], self.idf[at[first]], self.outside)
        return float((weight * np.where(known[first], self.weights[t][at[first]], 0)).sum() / np.sqrt((weight**2).sum()))

    def _best_passage(self, word: np.ndarray, at: np.ndarray, known: np.ndarray, t: int, threshold: float) -> tuple[float, int, int] | None:
        size, n = self.sizes[t], len(word)
        best, start, length = self._cosine(word, at, known, t), 0, n
        if n > size:
            row = np.where(known, self.weights[t][at], 0)
            held = np.concatenate([[0], np.cumsum(row**2)])
            live = np.flatnonzero(held[size:] - held[:-size] >= threshold**2 - 1e-9)
            runs = np.split(live, np.flatnonzero(np.diff(live) > size) + 1) if len(live) else []
            top, place = threshold**2 - 1e-9, -1
            for run in runs:
                a, b = int(run[0]), int(run[-1]) + size
                _, one, code = np.unique(word[a:b], return_index=True, return_inverse=True)
                idf = np.where(known[a:b][one], self.idf[at[a:b][one]], self.outside)
                f = self.factor(np.arange(size + 2)).tolist()
                square, inner, code, count = (idf**2).tolist(), (idf * row[a:b][one]).tolist(), code.tolist(), [0] * len(one)
                dot = norm = 0.0
                for p, c in enumerate(code):
                    if p >= size:
                        o = code[p - size]
                        k = count[o]
                        dot -= inner[o] * (f[k] - f[k - 1])
                        norm -= square[o] * (f[k] ** 2 - f[k - 1] ** 2)
                        count[o] = k - 1
                    k = count[c]
                    dot += inner[c] * (f[k + 1] - f[k])
                    norm += square[c] * (f[k + 1] ** 2 - f[k] ** 2)
                    count[c] = k + 1
                    if p >= size - 1 and dot * dot > top * norm:
                        top, place = dot * dot / norm, a + p - size + 1
            if place >= 0:
                exact = self._cosine(word[place : place + size], at[place : place + size], known[place : place + size], t)
                if exact > best:
                    best, start, length = exact, place, size
        return (best, start, length) if best >= threshold else None

    def best(self, unit: np.ndarray, word: np.ndarray, n: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """For each of n units of words (unit, hash) the best template at or above the threshold (-1: none), and its cosine."""
        found, score = np.full(n, -1), np.zeros(n)
        # equal cosines: the smaller name
        for u, t, c in sorted(self.above(unit, word, n, threshold), key=lambda x: (x[0], -round(x[2], 12), self.names[x[1]])):
            if found[u] < 0:
                found[u], score[u] = t, c
        return found, score

    def above(self, unit: np.ndarray, word: np.ndarray, n: int, threshold: float) -> list[tuple[int, int, float]]:
        """(unit, template, cosine) of the templates at or above the threshold for each of n units of words (unit, hash)."""
        at = np.minimum(np.searchsorted(self.vocabulary, word), len(self.vocabulary) - 1)
        inside = np.flatnonzero(self.vocabulary[at] == word)
        bound = np.zeros(n)
        for row in self.weights:
            bound = np.maximum(bound, np.bincount(unit[inside], weights=row[at[inside]] ** 2, minlength=n))
        likely = bound >= threshold**2 - 1e-9
        live = np.flatnonzero(likely)
        if not len(live):
            return []
        keep = np.flatnonzero(likely[unit])
        place = np.searchsorted(live, unit[keep])
        order = np.lexsort((word[keep], place))
        u, w, a = place[order], word[keep][order], at[keep][order]
        fresh = np.ones(len(u), bool)
        fresh[1:] = (u[1:] != u[:-1]) | (w[1:] != w[:-1])
        first = np.flatnonzero(fresh)
        tf = np.diff(np.append(first, len(u)))
        u, w, a = u[first], w[first], a[first]
        known = self.vocabulary[a] == w
        weight = self.factor(tf) * np.where(known, self.idf[a], self.outside)
        norm = np.sqrt(np.bincount(u, weights=weight**2, minlength=len(live)))
        cosine = np.stack([np.bincount(u[known], weights=weight[known] * row[a[known]], minlength=len(live)) for row in self.weights], 1) / np.maximum(norm, 1e-12)[:, None]
        return [(int(live[u]), int(t), float(cosine[u, t])) for u, t in np.argwhere(cosine >= threshold)]


def state(files: DataFrame, path: str = "path", text: str = "text", templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of `files`, with its other columns but the text: licence, cosine, line (0-based, the first of a passage; -1: the
    whole file), unclear, is_licence_file.

    A likeness counts if the words and version numbers that tell licences apart agree and nothing denies it just before; where
    none does, `unclear` names the licences that it is like. An SPDX expression in the text is taken as it stands, with
    cosine 1; the first of several. Columns of these names are replaced.
    """
    known = Templates(templates or TEMPLATES)
    long = [] if templates else [Templates(long_templates(), damped=True)]
    shared = files.sparkSession.sparkContext.broadcast([known, *long])
    others = [c for c in files.columns if c not in (text, *RESULTS)]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.select(*others).schema)

    def measure(batches):
        one = shared.value[0]
        for batch in batches:
            for row, offsets, data in bytescan.blocks(batch.column(len(others))):
                n = len(offsets) - 1
                found = bytescan.words(offsets, data, bytescan.ALNUM)
                of = np.repeat(np.arange(n), found.counts())
                ends = np.flatnonzero(data == 10)
                # lines are numbered through: line ends before a word, and the text's own number
                line = np.searchsorted(ends, found.begin) + of
                first_line = np.searchsorted(ends, offsets[:-1]) + np.arange(n)
                n_lines = len(ends) + n
                words_in, size = np.bincount(line, minlength=n_lines), found.counts()
                begins = np.searchsorted(line, np.arange(n_lines))  # the first word of each line
                # (text, cosine, name, line, agrees, says much of the text) of every passage, line and file that is like a template
                likely = []

                def take(known, t, k, c, begin, length, where, found=found, size=size, likely=likely):
                    agrees = Telling.agree(known, k, found.hashes[found.first[t] : found.first[t + 1]], begin, length)
                    likely.append((t, c, known.names[k], where, agrees, where < 0 or length >= FILE_SHARE * size[t]))

                for t, k, c in one.above(of, found.hashes, n, threshold):
                    take(one, t, k, c, 0, int(size[t]), -1)
                for u, k, c in one.above(line, found.hashes, n_lines, threshold):
                    t = int(np.searchsorted(first_line, u, side="right")) - 1
                    take(one, t, k, c, int(begins[u] - found.first[t]), int(words_in[u]), u - int(first_line[t]))
                for some in shared.value:
                    for t, k, c, begin, length in some.passages(found.hashes, found.first, threshold):
                        take(some, t, k, c, begin, length, -1 if length == size[t] else int(line[found.first[t] + begin] - first_line[t]))
                licence, score, where, unclear, whole = [None] * n, np.zeros(n), np.full(n, None, object), [set() for _ in range(n)], np.zeros(n, bool)
                for t, c, name, place, agrees, much in sorted(likely, key=lambda x: (x[0], -round(x[1], 12), x[2], -1 if x[3] is None else x[3])):
                    if agrees:
                        whole[t] |= much
                        if licence[t] is None:
                            licence[t], score[t], where[t] = name, c, place
                    elif agrees is not None:
                        unclear[t].add(name)
                # what is like a licence, but differs in a word that counts, is unclear where nothing else is said
                unclear = [sorted(u) if licence[i] is None and u else None for i, u in enumerate(unclear)]
                raw = data.tobytes()
                for at in reversed([m.start() for m in re.finditer(b"SPDX-License-Identifier:", raw)]):
                    t = int(np.searchsorted(offsets, at, side="right")) - 1
                    if (m := SPDX.match(raw, at, int(offsets[t + 1]))) and (said := spdx(m[1].decode("utf-8", "replace"))):
                        licence[t], score[t], where[t], unclear[t] = said, 1.0, int(np.searchsorted(ends, m.start())) + t - int(first_line[t]), None
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(row, n) for i in range(len(others))), pa.array(licence, pa.string()), pa.array(score), pa.array(where.tolist(), pa.int64()), pa.array(unclear, pa.list_(pa.string())), pa.array(whole)], [*others, "licence", "cosine", "line", "unclear", "is_licence_file"])

    return files.select(*others, text).mapInArrow(tidy(measure), f"{fields}, licence string, cosine double, line long, unclear array<string>, is_licence_file boolean")


def inherit(stated: DataFrame, path: str = "path") -> DataFrame:
    """`stated` with the licence that holds for each file: own, inherited (and from which directory) or none."""
    columns = stated.columns
    stated = stated.drop("how", "from_directory")
    kept = fresh_name(columns, "_directory")
    stated = stored(stated.withColumn(kept, F.regexp_replace(F.col(path), r"/?[^/]*$", "")), "stated")
    out, stated = stated, stated.select(path, "licence", "cosine", "is_licence_file", F.col(kept).alias("directory"))
    speaks = stated.where(F.col("licence").isNotNull() & F.col("directory").isNotNull() & (F.col("is_licence_file") | F.col(path).rlike(LICENCE_NAMES)))
    best = speaks.groupBy("directory").agg(F.min_by("licence", F.struct(-F.round("cosine", 12), F.col("licence"), F.col(path))).alias("granted"))
    parts = F.split("directory", "/")
    ancestors = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    # each directory once, however many files are in it
    every = stated.where(F.col("directory").isNotNull()).select("directory").distinct()
    up = every.withColumn("above", F.explode(F.array_distinct(F.concat(ancestors, F.array("directory")))))
    near = up.join(best.withColumnRenamed("directory", "above"), "above").groupBy("directory").agg(F.max_by(F.struct("granted", "above"), F.length("above")).alias("near"))
    near_name = fresh_name(columns, "_near")
    joined = join_hot(out, near.select(F.col("directory").alias(kept), F.col("near").alias(near_name)), kept, "left")
    own, found = F.col("licence").isNotNull(), F.col(near_name)
    return joined.select(*[c for c in out.columns if c not in (kept, "licence")], F.coalesce("licence", found["granted"]).alias("licence"), F.when(own, "own").when(found.isNotNull(), "inherited").otherwise("none").alias("how"), F.when(~own, found["above"]).alias("from_directory"))


def scan(files: DataFrame, path: str = "path", text: str = "text", **other) -> DataFrame:
    return inherit(state(files, path, text, **other), path)
