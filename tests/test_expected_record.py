"""The expected record against every pairing worked out one by one."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from panelspark.operators import h2h as H

SCHEMA = "team_id long, gw long, sample_mean double, sample_std double"


def phi(z):
    return 0.5 * math.erfc(-z / math.sqrt(2))


def brute(rows):
    played, wins = {}, {}
    for t, g, m, s in rows:
        for o, h, rm, rs in rows:
            if h != g or o == t:
                continue
            v = math.hypot(s, rs)
            p = phi((m - rm) / v) if v else 0.5 if m == rm else float(m > rm)
            played[t] = played.get(t, 0) + 1
            wins[t] = wins.get(t, 0.0) + p
    return played, wins


def spreads(kind, rng):
    return {
        "few": lambda: rng.choice([0.0, 25.0, 50.0, 75.0]),
        "continuous": lambda: 10 ** rng.uniform(-1, 2),
        "none": lambda: 0.0,
        "tiny and huge": lambda: rng.choice([1e-6, 1e-3, 4.0, 1e4]),
    }[kind]


@pytest.mark.parametrize("kind", ["few", "continuous", "none", "tiny and huge"])
def test_against_all_pairs(spark, kind):
    rng = random.Random(len(kind))
    spread = spreads(kind, rng)
    means = [rng.gauss(0, 300) for _ in range(60)]
    rows = [(t, g, rng.choice(means) if t % 3 else rng.uniform(-900, 900), spread())
            for g in (1, 2) for t in range(110)]
    played, wins = brute(rows)
    got = {r.team_id: r for r in
           H.expected_record(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {t: r.played for t, r in got.items()} == played
    worst = max(abs(got[t].exp_wins - wins[t]) for t in wins)
    assert worst < 1e-10
    assert sum(r.exp_wins for r in got.values()) == pytest.approx(2 * 110 * 109 / 2, abs=1e-8)


def test_period_of_copies(spark):
    """One cell that most squads share, beside a period of one squad and one of two."""
    rows = [(t, 1, 50.0, 5.0) for t in range(400)] + [(900, 1, 51.0, 0.0), (1, 2, 3.0, 1.0),
            (2, 3, 3.0, 0.0), (3, 3, 3.0, 0.0)]
    got = {r.team_id: r.exp_wins for r in
           H.expected_record(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[900] == pytest.approx(400 * phi(0.2), abs=1e-10)
    assert got[0] == pytest.approx(399 * 0.5 + 1 - phi(0.2), abs=1e-10)
    assert got[2] == pytest.approx(got[0] + 0.5, abs=1e-10)


def test_rows_without_numbers_and_empty(spark):
    rows = [(1, 1, None, 1.0), (2, 1, 1.0, None), (3, 1, 1.0, 2.0), (4, 1, 1.0, 2.0),
            (5, 1, math.nan, 1.0), (6, 1, 1.0, math.inf)]
    got = {r.team_id: (r.played, round(r.exp_wins, 12)) for r in
           H.expected_record(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {3: (1, 0.5), 4: (1, 0.5)}
    assert H.expected_record(spark.createDataFrame([], SCHEMA)).count() == 0


def test_bound_of_the_series():
    """Sum of the terms left out, by Cramer's bound on Hermite functions."""
    x, u = 1.0, (H.SPREAD_RATIO - 1) / (H.SPREAD_RATIO + 1)
    terms = [1.0]
    for k in range(250):
        terms.append((x * terms[k] + (u * terms[k - 1] if k else 0.0)) / (k + 1))
    left = sum(1.0866 / math.sqrt(2 * math.pi) * math.exp(0.5 * math.lgamma(k)) * terms[k]
               for k in range(H.ORDER + 1, 250))
    assert left < 1e-12
    assert 0.5 * math.erfc(H.CERTAIN / math.sqrt(2)) < np.finfo(float).eps
