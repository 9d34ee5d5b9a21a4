"""Scans and trailing percentiles against plain loops, whatever the chunk."""

import random

import numpy as np
import pytest

from chronotext.operators import scans, signal


def loop_states(m, v, x, s):
    out = [s]
    for row in x:
        s = m @ s + v @ row
        out.append(s)
    return np.array(out)


@pytest.mark.parametrize("n", [0, 1, 5, 64, 65, 1000, 9000])
def test_states(n):
    rng = np.random.default_rng(n)
    m, v = rng.normal(size=(3, 3)) / 3, rng.normal(size=(3, 2))
    x, s = rng.normal(size=(n, 2)), rng.normal(size=3)
    assert np.allclose(scans.affine_states(m, v, x, s), loop_states(m, v, x, s))
    y, want = np.zeros(2), []
    for row in x:
        y = 0.98 * y + row
        want.append(y)
    assert np.allclose(scans.decayed(0.98, x), np.array(want).reshape(-1, 2))


def test_high_pass_kernel_is_the_difference_equation():
    x = np.random.default_rng(1).normal(size=3000)
    w = 2 * np.pi * 100 / 8000
    alpha, c = np.sin(w) / np.sqrt(2), np.cos(w)
    y = np.zeros(len(x))
    for i in range(len(x)):
        x1, x2, y1, y2 = (x[i - 1] if i else 0, x[i - 2] if i > 1 else 0, y[i - 1] if i else 0, y[i - 2] if i > 1 else 0)
        y[i] = ((1 + c) / 2 * (x[i] - 2 * x1 + x2) + 2 * c * y1 - (1 - alpha) * y2) / (1 + alpha)
    assert np.allclose(signal.high_pass(x, 8000, 100), y, atol=1e-5)


def media(n, seed=3):
    random.seed(seed)
    return [("long" if random.random() < 0.5 else f"m{random.randrange(9)}", i, random.choice([None, 0.0, 1.5, random.random()])) for i in range(n)]


@pytest.mark.parametrize("chunk", [16, 100, 1 << 16])
def test_scan_of_media(spark, chunk):
    rows = media(900)
    frame = spark.createDataFrame(rows, "m string, i long, x double").repartition(5)
    got = scans.high_pass(frame, ["m"], ["i"], "x", 8000, 300, chunk=chunk).collect()
    assert len(got) == len(rows)
    for name in {r[0] for r in rows}:
        own = sorted((r for r in got if r["m"] == name), key=lambda r: r["i"])
        want = signal.high_pass(np.array([r["x"] or 0.0 for r in own]), 8000, 300)
        assert np.allclose([r["high"] for r in own], want, atol=1e-5)
    smooth = scans.affine_scan(frame, ["m"], ["i"], ["x"], [[0.9]], [[0.1]], ["y"], chunk).collect()
    for name in {r[0] for r in rows}:
        y = 0.0
        for r in sorted((r for r in smooth if r["m"] == name), key=lambda r: r["i"]):
            y = 0.9 * y + 0.1 * (r["x"] or 0.0)
            assert abs(r["y"] - y) < 1e-9


def test_trailing_percentile_of_columns():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 5, size=(300, 4)).astype(float)
    for most, fraction in ((1, 0.1), (7, 0.5), (125, 0.1), (400, 0.9)):
        window = scans.TrailingPercentile(fraction, most, 4)
        for i, row in enumerate(x):
            held = np.sort(x[max(0, i - most + 1) : i + 1], axis=0)
            assert (window.push(row) == held[int(np.floor(fraction * (len(held) - 1)))]).all()


@pytest.mark.parametrize("chunk", [5, 64, 1 << 16])
def test_trailing_percentile_of_media(spark, chunk):
    rows = media(600, 5)
    frame = spark.createDataFrame([(*r, r[1] % 4 != 0) for r in rows], "m string, i long, x double, loud boolean").repartition(4)
    got = scans.trailing_percentile(frame, ["m"], ["i"], "x", 0.3, 12, "low", "loud", chunk=chunk).collect()
    assert len(got) == len(rows)
    for name in {r[0] for r in rows}:
        held = []
        for r in sorted((r for r in got if r["m"] == name), key=lambda r: r["i"]):
            if r["x"] is not None and r["loud"]:
                held = [*held, r["x"]][-12:]
            want = sorted(held)[int(0.3 * (len(held) - 1))] if held else None
            assert r["low"] == want
