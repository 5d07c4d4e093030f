"""The volume under the precision-recall surface against a loop over widths, thresholds and spans."""

from __future__ import annotations

import time

import numpy as np
import pytest

from scoreloom.operators import metrics


def labels(y, window):
    spans = [i for i, v in enumerate(y) if v]
    out = []
    for i, v in enumerate(y):
        d = min(abs(i - k) for k in spans)
        out.append(1.0 if v else np.sqrt(1 - d / window) if window and d <= window // 2 else 0.0)
    return np.array(out)


def plain(y, score, window, thresholds):
    order = sorted(range(len(y)), key=lambda i: (-score[i], i))
    picks = sorted({int(v) for v in np.linspace(0, len(y) - 1, thresholds)})
    spans, i = [], 0
    while i < len(y):
        if y[i]:
            j = i
            while j < len(y) and y[j]:
                j += 1
            spans.append((i, j))
            i = j
        i += 1
    areas = []
    for w in range(window + 1):
        soft, before, area = labels(y, w), 0.0, 0.0
        for k in picks:
            level = score[order[k]]
            said = [i for i in range(len(y)) if score[i] >= level]
            hit = sum(soft[i] for i in said)
            found = sum(max(score[max(0, a - w // 2) : b + w // 2]) >= level for a, b in spans) / len(spans)
            recall = min(hit / ((sum(y) + soft.sum()) / 2), 1) * found
            area += (recall - before) * hit / len(said)
            before = recall
        areas.append(area)
    return float(np.mean(areas))


@pytest.mark.parametrize("seed", range(12))
def test_one_sweep_equals_the_loop(seed):
    rng = np.random.default_rng(seed)
    n, window = int(rng.integers(5, 90)), int(rng.integers(0, 24))
    y = (np.convolve(rng.random(n) < 0.06, np.ones(int(rng.integers(1, 6))))[:n] > 0).astype(int)
    y[int(rng.integers(n))] = 1
    if seed % 3 == 0:
        y[0] = y[-1] = 1
    y[int(rng.integers(n))] = 0
    score = rng.integers(0, 7, n) / 6 if seed % 2 else rng.random(n)
    if 0 < y.sum() < n:
        assert metrics.vus_pr(y, score, window, 20) == pytest.approx(plain(y.tolist(), score, window, 20), abs=1e-12)


def test_degenerate_inputs_give_zero():
    assert metrics.vus_pr(np.zeros(9), np.arange(9.0), 4) == metrics.vus_pr(np.ones(9), np.arange(9.0), 4) == metrics.vus_pr([0, 1, 0], np.ones(3), 2) == 0.0


def test_time_of_a_long_series():
    rng = np.random.default_rng(1)
    y = (np.convolve(rng.random(500_000) < 0.001, np.ones(30))[:500_000] > 0).astype(int)
    began = time.perf_counter()
    assert 0 < metrics.vus_pr(y, rng.random(500_000), 300) < 1
    assert time.perf_counter() - began < 20
