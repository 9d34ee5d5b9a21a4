"""Queries that SQL cannot state, over whole small tables and row by row against plain Python."""

import re

import numpy as np
import pytest

from chronotext.operators import translate
from chronotext.plans.registry import QUERIES

# Spanish sounds, read letter by letter

VOWELS = dict(zip("aeiouáéíóúü", "aeiouaeiouu", strict=True))
SINGLE = {"z": "s", "v": "b", "x": "ks", "y": "i", "c": "k", "q": "k", "j": "x", "ñ": "ɲ", "h": ""}


def spoken(word):
    """(letter, sound) of each step, with an empty letter for consonants."""
    w, i, out = word.lower(), 0, []
    while i < len(w):
        here, after = w[i], w[i + 1 : i + 2]
        two = {"qu": "k", "ll": "ʝ", "rr": "r", "ch": "tʃ"}.get(w[i : i + 2])
        step = 1
        if two:
            letter, sound, step = "", two, 2
        elif w[i : i + 2] == "gu" and w[i + 2 : i + 3] in ("e", "i"):
            letter, sound, step = "", "g", 2
        elif here in "gc" and after and after in "ei":
            letter, sound = "", "x" if here == "g" else "s"
        elif here == "y" and after and after in VOWELS:
            letter, sound = "", "ʝ"
        elif here == "r":
            letter, sound = "", "r" if i == 0 or (out and not out[-1][0] and out[-1][1] in ("n", "l", "s")) else "ɾ"
        elif here in VOWELS:
            letter, sound = here, VOWELS[here]
        else:
            letter, sound = "", SINGLE.get(here, here)
        out.append((letter, sound))
        i += step
    return out


def spanish(word):
    steps = spoken(word)
    letters, sounds = [a for a, _ in steps], [b for _, b in steps]
    at = [i for i, a in enumerate(letters) if a]
    for i, s in enumerate(sounds):
        if 0 < i < len(steps) - 1 and not letters[i] and letters[i - 1] and letters[i + 1]:
            sounds[i] = {"b": "β", "d": "ð", "g": "ɣ"}.get(s, s)
    if not at:
        return "".join(sounds)
    marked = [i for i in at if letters[i] in "áéíóú"]
    stress = marked[0] if marked else at[-2] if len(at) > 1 and word[-1] in "aeiounáéíóú" else at[-1]
    for i in at:
        beside = [letters[j] for j in (i - 1, i + 1) if 0 <= j < len(steps) and letters[j]]
        if letters[i] in "iuü" and i != stress and any(x not in "iuü" for x in beside):
            sounds[i] = "j" if letters[i] == "i" else "w"
    start = stress
    while start and letters[start - 1] and letters[start - 1] in "iuü":
        start -= 1
    if not any(letters[:start]):
        start = 0
    else:
        run = start
        while run and not letters[run - 1]:
            run -= 1
        if start - run == 1:
            start -= 1
        elif start - run > 1:
            a, b = steps[start - 2][1], steps[start - 1][1]
            start -= 2 if (b in ("l", "r") and a in ("b", "c", "d", "f", "g", "k", "p", "t")) or (a == "s" and b in ("p", "t", "k")) else 1
    return "".join(sounds[:start]) + "ˈ" + "".join(sounds[start:])


def in_spanish(text):
    """Runs between white space with one word of letters and apostrophes in them, and no letter beside it, are spoken."""
    out = []
    for chunk in re.split(r"(\s+)", text):
        letters = [i for i, c in enumerate(chunk) if c.isalpha()]
        if letters:
            a, b = letters[0], letters[-1] + 1
            while b < len(chunk) and chunk[b] in "'’":
                b += 1
            if all(c.isalpha() or c in "'’" for c in chunk[a:b]):
                chunk = chunk[:a] + spanish(chunk[a:b]) + chunk[b:]
        out.append(chunk)
    return "".join(out)


def test_spanish_texts(spark, tmp_path):
    random = np.random.default_rng(31)
    parts = ["gue", "gui", "que", "güi", "lla", "rro", "cha", "ñu", "ción", "ge", "ci", "ya", "buey", "ble", "tra", "ins", "al", "re", "via", "áu", "zo", "ho", "xi", "ab", "d", "s", "n", "Es", "kw"]
    rows = []
    for i in range(300):
        said = ["".join(random.choice(parts, int(random.integers(1, 5)))) for _ in range(int(random.integers(1, 25)))]
        rows.append((i, "  ".join("¿" * (k % 3 == 0) + w + ",?’"[k % 4 : k % 4 + 1] for k, w in enumerate(said)), ("es", "es-MX", "en", None)[i % 4]))
    rows += [(900, None, "es"), (901, "", "es"), (902, "a1b 42 ¡sí! pst\n\tlago", "es"), (903, "niño " * 5000, "es")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["ipa"] for r in QUERIES["spanish_ipa"](spark, str(tmp_path)).collect()}
    assert got == {i: in_spanish(t) if t and (x or "").startswith("es") else t for i, t, x in rows}


# blocks of cues, translated together and cut apart again


def cut_apart(text, parts):
    """As split_proportionally promises, by a look at every white space for every border."""
    text, n = text.strip(), len(parts)
    if not text:
        return [""] * n
    sizes = [len(re.sub(r"\s", "", p)) for p in parts]
    sizes = sizes if any(sizes) else [1] * n
    out, here = [], 0
    for i in range(n - 1):
        ideal, low = int(len(text) * sum(sizes[: i + 1]) / sum(sizes) + 0.5), here + 1
        high = max(low, len(text) - (n - 1 - i))
        inside = [m.span() for m in re.finditer(r"\s+", text) if m.start() >= low and m.end() <= high]
        best = min(inside, key=lambda g: (abs(g[0] - ideal), g[0]), default=None)
        if best is None or not text[here : best[0]].strip():
            best = (min(max(ideal, low), high),) * 2
        out.append(text[here : best[0]].strip())
        here = best[1]
    return [*out, text[here:].strip()]


def by_blocks(texts, translator):
    out, block = [], []

    def close():
        if block:
            try:
                out.extend((t, None) for t in cut_apart(translator([" ".join(block)], "en", "es")[0], block))
            except ValueError:
                for t in block:
                    try:
                        out.append((translator([t], "en", "es")[0], None))
                    except ValueError as e:
                        out.append((t, str(e)))
            block.clear()

    for t in texts:
        visible = lambda x: len(re.sub(r"\s", "", x))
        if block and (len(block) == 6 or sum(map(visible, block)) + visible(t) > 400):
            close()
        block.append(t)
    close()
    return out


def longer():
    def run(texts, source, target):
        if any("boom" in t for t in texts):
            raise ValueError("boom")
        return [" ".join(w + "amente" * (len(w) % 3) for w in t.split()) for t in texts]

    return run


def shorter():
    return lambda texts, source, target: [" ".join(t.split()[::3]) for t in texts]


@pytest.fixture(scope="module")
def conversations(spark, tmp_path_factory):
    random = np.random.default_rng(5)
    rows = []
    for c in range(40):
        for turn in range(int(random.integers(1, 20))):
            said = " ".join("abcdefghij"[: int(n)] for n in random.integers(1, 10, int(random.integers(1, 60))))
            rows.append((c, turn, "user", [said, said + " boom", "", None, "  x  "][int(random.choice(5, p=[0.8, 0.05, 0.05, 0.05, 0.05]))]))
    folder = tmp_path_factory.mktemp("turns")
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(3).write.parquet(f"{folder}/conversations.parquet")
    return str(folder), rows


def expected(rows, translator):
    out = []
    for c in sorted({r[0] for r in rows}):
        own = sorted((r for r in rows if r[0] == c), key=lambda r: r[1])
        out += [(c, r[1], t, e) for r, (t, e) in zip(own, by_blocks([r[3] or "" for r in own], translator), strict=True)]
    return sorted(out, key=repr)


def test_translated_blocks(spark, conversations):
    folder, rows = conversations
    got = [tuple(r) for r in QUERIES["translate_blocks"](spark, folder).select("conv_id", "turn", "translation", "error").collect()]
    assert sorted(got, key=repr) == expected(rows, translate.identity)


@pytest.mark.parametrize("kind", [longer, shorter])
def test_translators_that_change_lengths(spark, conversations, kind):
    translator = kind()  # made here, so that workers get it by value
    folder, rows = conversations
    cues = spark.read.parquet(f"{folder}/conversations.parquet")
    got = [tuple(r) for r in translate.translate_cues(cues, ["conv_id"], "turn", "text", "en", "es", translator).select("conv_id", "turn", "translation", "error").collect()]
    want = expected(rows, translator)
    assert sorted(got, key=repr) == want
    assert kind is shorter or any(e for *_, e in want)
