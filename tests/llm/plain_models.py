"""Toxicity and language ID over lists of rows, written out in plain Python: what the operators are held against."""

import math
import re
import zlib
from collections import Counter

from chronotext.llm import langid, toxicity


def held_out(key):
    return key is not None and zlib.crc32(str(key).encode()) % 5 == 0


# toxicity


def terms(text):
    """The (term, occurrence) pairs of a text: words and what longer ones begin with, each occurrence a term of its own."""
    data = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    seen = Counter()
    for w in re.findall(rb"[0-9a-z\x80-\xff]+", data):
        seen[0, w] += 1
        for k in (4, 5, 6):
            if len(w) > k:
                seen[k, w[:k]] += 1
    return {(t, i) for t, n in seen.items() for i in range(n)}


def monotone(points):
    """The non-decreasing fit of (x, y, weight) by the largest of smallest averages, as knots over runs of equal value."""
    points = sorted(points, key=lambda p: p[0])
    n, fit = len(points), []
    sums = [(0.0, 0.0)]
    for _, y, w in points:
        sums.append((sums[-1][0] + y * w, sums[-1][1] + w))
    mean = lambda a, b: (sums[b][0] - sums[a][0]) / (sums[b][1] - sums[a][1])
    for i in range(n):
        fit.append(max(min(mean(a, b) for b in range(i + 1, n + 1)) for a in range(i + 1)))
    knots, a = [], 0
    while a < n:
        b = a
        while b < n and abs(fit[b] - fit[a]) < 1e-9:
            b += 1
        weight = sums[b][1] - sums[a][1]
        rate = min(max((mean(a, b) * (b - a) + 1) / (b - a + 2), 0.001), 0.999)
        knots.append((sum(x * w for x, _, w in points[a:b]) / weight, max([rate, *(y for _, y in knots)])))
        a = b
    return knots


def between(knots, x):
    if x <= knots[0][0]:
        return knots[0][1]
    for (x0, y0), (x1, y1) in zip(knots, knots[1:], strict=False):
        if x <= x1:
            return y0 + (y1 - y0) * (x - x0) / (x1 - x0)
    return knots[-1][1]


def toxic_scores(docs, labels):
    """(score, evidence) of every (key, text) of `docs`; labels are (key, 0 or 1) that may be learned from, fewer than a sample."""
    examples = sorted((k, y, t) for k, t in docs for key, y in labels if k is not None and k == key)
    whole, size = Counter(y for _, y in labels), Counter(y for _, y, _ in examples)
    counts = {0: Counter(), 1: Counter()}
    for _, y, t in examples:
        counts[y].update(terms(t))
    every, idf = set(counts[0]) | set(counts[1]), {}
    base = size[1] / len(examples)
    for t in every:
        a, b = counts[1][t], counts[0][t]
        n, rate = a + b, a / (a + b)
        part = lambda p, q: p * math.log(p / q) if p > 0 else 0.0
        if rate > base and n * (part(rate, base) + part(1 - rate, 1 - base)) > math.log(max(2, len(every))):
            idf[t] = 1 + math.log(sum(whole.values()) / (a / size[1] * whole[1] + b / size[0] * whole[0]))

    def vector(text):
        have = [t for t in terms(text) if t in idf]
        norm = math.sqrt(sum(idf[t] ** 2 for t in have))
        return {t: idf[t] / norm for t in have}

    known = [(k, y, vector(t), whole[y] / size[y]) for k, y, t in examples]

    def nearest(v, without=-1):
        found = [(-round(sum(w * x.get(t, 0.0) for t, w in v.items()), 12), i) for i, (_, _, x, _) in enumerate(known) if i != without]
        return [(i, min(-c, 1.0)) for c, i in sorted(found) if c < 0][: toxicity.NEIGHBOURS]

    def share(found):
        votes = [(known[i][3] / (1 - c + toxicity.SOFTEN), known[i][1]) for i, c in found]
        return sum(v * y for v, y in votes) / sum(v for v, _ in votes)

    own = [nearest(x, i) for i, (_, _, x, _) in enumerate(known)]
    bare = [(e[1], e[3]) for e, found in zip(known, own, strict=True) if not found] or [(e[1], e[3]) for e in known]
    constant = min(max(sum(y * w for y, w in bare) / sum(w for _, w in bare), 0.001), 0.999)
    knots = monotone([(share(found), e[1], e[3]) for e, found in zip(known, own, strict=True) if found])
    out = []
    for _, text in docs:
        found = nearest(vector(text))
        out.append((between(knots, share(found)) if found else constant, [(str(known[i][0]), c, known[i][1]) for i, c in found]))
    return out


# language ID


def script(c):
    return next((i for i, ranges in enumerate(langid.SCRIPTS.values(), 1) if any(a <= ord(c) <= b for a, b in ranges)), langid.OTHER) if c.isalpha() else 0


def words(text):
    out, run = [], ""
    for c in (text or "") + "\n":
        if c.isalpha():
            run += c
        elif run:
            out.append(run)
            run = ""
    return out


def slots(word):
    """Hashed trigrams of a word with its borders."""
    low = [ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in word]
    p, full, out = [0, 0, *low, 0], 1 << 32, []
    for two, one, c in zip(p, p[1:], p[2:], strict=False):
        h = (c * 0x9E3779B1 % full) ^ ((one * 0x85EBCA77 + two * 0xC2B2AE3D) % full)
        out.append((h ^ (h >> 15)) * 0x2C1B3C6D % full >> (32 - langid.BITS))
    return out


def languages(docs, labelled):
    """(language, score, number of spans) of every text of `docs`; labelled are (text, language) to learn from."""
    labelled = [(t, x) for t, x in labelled if t is not None and x is not None]
    names = sorted({x for t, x in labelled if words(t)})
    counts, letters, rows = ({n: Counter() for n in names} for _ in range(3))
    for t, x in labelled:
        if x in names:
            rows[x]["n"] += 1
            for w in words(t):
                counts[x].update(slots(w))
                letters[x][script(w[0])] += len(w)
    seen = len({s for c in counts.values() for s in c})
    total = {n: sum(counts[n].values()) for n in names}
    prior = [math.log(rows[n]["n"] / sum(r["n"] for r in rows.values())) for n in names]
    candidate = lambda s, n: letters[n][s] >= langid.SCRIPT_SHARE * max(sum(letters[n].values()), 1)

    def scores(word):
        ok = [candidate(script(word[0]), n) for n in names]
        if not any(ok):
            return [0.0] * len(names)
        raw = [sum(math.log((counts[n][s] + 0.1) / (total[n] + 0.1 * seen)) for s in slots(word)) for n in names]
        best = max(r for r, o in zip(raw, ok, strict=True) if o)
        return [max(r - best, -30.0) if o else -60.0 for r, o in zip(raw, ok, strict=True)]

    def path(rows):
        value, back = list(prior), []
        for row in rows:
            top = max(range(len(names)), key=lambda j: value[j])
            came = [j if value[j] >= value[top] - langid.SWITCH_PENALTY else top for j in range(len(names))]
            value = [max(value[j], value[top] - langid.SWITCH_PENALTY) + row[j] for j in range(len(names))]
            back.append(came)
        j = max(range(len(names)), key=lambda j: value[j])
        out = []
        for came in reversed(back):
            out.append(j)
            j = came[j]
        return out[::-1]

    out = []
    for text in docs:
        said = words(text)
        if not said or not names:
            out.append(("und", 0.0, 0))
            continue
        rows_of = [scores(w) for w in said]
        labels = path(rows_of)
        by = [sum(len(w) for w, x in zip(said, labels, strict=True) if x == j) for j in range(len(names))]
        best = max(range(len(names)), key=lambda j: by[j])
        name, sure = names[best], by[best] / sum(by)
        if all(max(r) == min(r) for r in rows_of):
            name, sure = names[max(range(len(names)), key=lambda j: prior[j])], 1 / len(names)
        out.append((name, sure, 1 + sum(a != b for a, b in zip(labels, labels[1:], strict=False))))
    return out
