"""Statements that are worded alike, denials and SPDX expressions, and the whole scan against plain Python."""

import re
from collections import Counter

import numpy as np
import pytest

from chronotext.llm import bytescan, licences

STATEMENTS = {
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3.", dict(licences.HEADERS)["AGPL-3.0"]],
    "LGPL-2.1": ["This work is licensed under the GNU Lesser General Public License, version 2.1."],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "CC-BY-NC-4.0": ["This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0."],
    "CC-BY-SA-4.0": ["This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-SA-4.0": ["Licensed under CC BY-NC-SA 4.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0."],
    "ISC": ["Licensed under the ISC License.", dict(licences.HEADERS)["ISC"]],
    "MIT": ["Licensed under the MIT License."],
    "Unlicense": [dict(licences.HEADERS)["Unlicense"]],
    "Zlib": [dict(licences.HEADERS)["Zlib"]],
    "EPL-2.0": [dict(licences.HEADERS)["EPL-2.0"]],
    "MIT OR Apache-2.0": ["// SPDX-License-Identifier: (MIT OR Apache-2.0)"],
}
PROSE = "the words of this sentence say nothing of the kind at all " * 20


def test_statements_that_are_worded_alike(spark):
    rows = [(f"{i}/{j}{k}.c", before + said + after, name) for i, (name, many) in enumerate(STATEMENTS.items()) for j, said in enumerate(many) for k, (before, after) in enumerate([("", ""), (PROSE, "\n" + PROSE)])]
    rows += [("no/a.c", "This file is not licensed under the MIT License.", None), ("no/b.c", "It was never released under the MIT License.", None), ("no/c.c", "This work is licensed under the Creative Commons Attribution 3.0 International License.", None)]
    got = {r["path"]: r for r in licences.state(spark.createDataFrame([r[:2] for r in rows], "path string, text string")).collect()}
    assert {p: got[p]["licence"] for p, _, _ in rows} == {p: name for p, _, name in rows}
    assert got["no/c.c"]["unclear"] == ["CC-BY-4.0"] and got["no/a.c"]["unclear"] is None


def test_affero_text_is_not_the_general_one(spark):
    texts = dict(licences.long_templates()[len(licences.HEADERS) :])
    affero = texts["AGPL-3.0"].replace("Use with the", "Remote Network Interaction; Use with the")
    got = {r["path"]: r["licence"] for r in licences.state(spark.createDataFrame([("a", affero), ("g", texts["GPL-3.0"])], "path string, text string")).collect()}
    assert got == {"a": "AGPL-3.0", "g": "GPL-3.0"}


@pytest.mark.parametrize(("said", "want"), [
    ("MIT", "MIT"), ("(MIT OR Apache-2.0)", "MIT OR Apache-2.0"), ("GPL-2.0-only WITH Classpath-exception-2.0 */", "GPL-2.0-only WITH Classpath-exception-2.0"), ("MIT AND (ISC OR Zlib) -->", "MIT AND (ISC OR Zlib)"),
    ("(MIT AND ISC) OR Zlib", "MIT AND ISC OR Zlib"), ("((MIT))", "MIT"), ("LicenseRef-own", "LicenseRef-own"), ("GPL-2.0+", "GPL-2.0+"), ("MIT OR", "MIT"), ("(MIT", None), ("", None), ("OR MIT", None), ("*/", None), ("MIT more words", "MIT"),
])
def test_expressions(said, want):
    assert licences.spdx(said) == want


def words(text):
    return re.findall(r"[0-9a-z]+", text.lower())


def test_best_passage_is_the_best_of_all():
    rng = np.random.default_rng(4)
    for damped in (False, True):
        known = licences.Templates(licences.TEMPLATES[:8], damped=damped)
        vocabulary = sorted({w for _, t in licences.TEMPLATES[:8] for w in words(t)}) + ["other", "words"]
        for _ in range(40):
            text = " ".join(rng.choice(vocabulary, rng.integers(3, 40)))
            if rng.random() < 0.7:
                text += " " + licences.TEMPLATES[rng.integers(0, 8)][1] + " other " + " ".join(rng.choice(vocabulary, 5))
            _, offsets, data = next(bytescan.blocks(__import__("pyarrow").array([text])))
            found = bytescan.words(offsets, data, bytescan.ALNUM)
            got = {t: (c, b, n) for _, t, c, b, n in known.passages(found.hashes, found.first, 0.6)}
            said = words(text)
            factor = (lambda k: 1 + np.log(k)) if damped else float
            df = Counter(w for _, t in licences.TEMPLATES[:8] for w in set(words(t)))
            idf = lambda w, df=df: np.log(9 / (1 + df[w])) + 1 if w in df else np.log(9 / 2) + 1

            def vector(part, idf=idf, factor=factor):
                return {w: factor(k) * idf(w) for w, k in Counter(part).items()}

            for t, (_, template) in enumerate(licences.TEMPLATES[:8]):
                own = vector(words(template))
                size = len(words(template))
                best = 0.0
                for a, b in [(0, len(said)), *((i, i + size) for i in range(len(said) - size + 1) if len(said) > size)]:
                    v = vector(said[a:b])
                    best = max(best, sum(v[w] * own.get(w, 0) for w in v) / np.sqrt(sum(x * x for x in v.values()) * sum(x * x for x in own.values())))
                assert (t in got) == (best >= 0.6) or abs(best - 0.6) < 1e-9
                assert t not in got or abs(got[t][0] - best) < 1e-9


def test_scan_of_a_tree(spark):
    """Own statements, licence files and the nearest directory, against a walk in plain Python."""
    mit, isc, gpl = "Licensed under the MIT License.", "Licensed under the ISC License.", "This work is licensed under the GNU General Public License, version 3."
    files = {"LICENSE": mit, "a.c": PROSE, "src/x.c": PROSE, "src/LICENSE.txt": PROSE + isc, "src/deep/er/y.c": "", "src/deep/z.c": gpl + "\n" + PROSE, "lib/COPYING": "Copyright someone", "lib/q.c": PROSE, "lib/own/w.c": gpl, "lib/own/v.c": PROSE}
    stated = {p: next((n for n, s in (("MIT", mit), ("ISC", isc), ("GPL-3.0", gpl)) if s in t), None) for p, t in files.items()}
    speaks = {p: n for p, n in stated.items() if n and (re.search(licences.LICENCE_NAMES.removeprefix("(?i)"), p, re.I) or len(words(files[p])) < 2 * len(words(gpl)))}

    def holds(path):
        if stated[path]:
            return stated[path], "own", None
        folder = path.rpartition("/")[0]
        while True:
            found = sorted(n for p, n in speaks.items() if p.rpartition("/")[0] == folder)
            if found:
                return found[0], "inherited", folder
            if not folder:
                return None, "none", None
            folder = folder.rpartition("/")[0]

    got = {r["path"]: (r["licence"], r["how"], r["from_directory"]) for r in licences.scan(spark.createDataFrame(list(files.items()), "path string, text string")).collect()}
    assert got == {p: holds(p) for p in files}
