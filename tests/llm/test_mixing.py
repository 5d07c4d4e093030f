"""The Pfair plan against a plain simulation, slot by slot, and its size for many sources."""

from __future__ import annotations

import random
import time
from fractions import Fraction
from math import ceil, floor

import pytest

from scoreloom.llm import mixing


def slots_of(rows):
    return {(s, k): base + (k - first) // len(picks) * size + picks[(k - first) % len(picks)] for s, first, behind, base, picks, size in rows for k in range(first, behind)}


def simulated(blocks, weights, resolution):
    """Each block's slot by its definition: of the released blocks of a phase the one of the earliest deadline, all blocks looked at in every slot."""
    left, done, slot, out = {s: n for s, n in blocks.items() if n}, dict.fromkeys(blocks, 0), 0, {}
    while left:
        num = mixing.shares({s: weights[s] for s in left}, max(resolution, 4 * len(left)))
        whole, began, served = sum(num.values()), slot, dict.fromkeys(left, 0)
        target = {s: Fraction(num[s], whole) for s in left}
        while all(left.values()):
            open_blocks = []
            for s in left:
                k = served[s]
                if floor(k / target[s]) <= slot - began:
                    open_blocks.append((ceil((k + 1) / target[s]), s is None, s or "", s))
            due, *_, s = min(open_blocks)
            assert due > slot - began  # no deadline is missed
            out[s, done[s]] = slot
            served[s] += 1
            done[s] += 1
            left[s] -= 1
            slot += 1
            assert all(abs(served[x] - target[x] * (slot - began)) < 1 for x in left)
        left = {s: n for s, n in left.items() if n}
    return out


@pytest.mark.parametrize("seed", range(8))
def test_plan_equals_a_plain_simulation(seed):
    rng = random.Random(seed)
    blocks = {f"s{i}" if i else None: rng.randrange(0, rng.choice([3, 20, 90])) for i in range(rng.randrange(1, 9))}
    weights = {s: (n + 1) ** 0.5 for s, n in blocks.items()}
    rows = mixing.phases(blocks, weights, 40)
    assert slots_of(rows) == simulated(blocks, weights, 40)


def test_plan_of_many_sources_has_no_more_rows_than_blocks():
    rng = random.Random(1)
    blocks = {f"s{i}": rng.randrange(1, 40) for i in range(1500)}
    began = time.perf_counter()
    rows = mixing.phases(blocks, {s: n**0.5 for s, n in blocks.items()}, 1000)
    assert len(rows) <= sum(blocks.values()) and time.perf_counter() - began < 60
    assert sorted(slots_of(rows).values()) == list(range(sum(blocks.values())))
