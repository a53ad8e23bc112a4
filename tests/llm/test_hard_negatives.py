"""Hard negatives against sorting all scores."""

import math
import random

import pytest

from conftest import frame
from marketlens.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<double>, label int, row string, score string, group int"


def table(spark, rows):
    return frame(spark, SCHEMA, *[(*r, "x", "y", 1) for r in rows]).repartition(3)


def expected(rows, k=hn.POSITIVES, m=hn.NEGATIVES):
    taking = [
        (i, [math.floor(256 * x) for x in v], l)
        for i, v, l in rows
        if l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for n, (anchor, v, label) in enumerate(taking):
        if anchor is None or anchor % 100:
            continue
        others = [
            (-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(v, w, strict=True)))), math.inf if i is None else i, l)
            for j, (i, w, l) in enumerate(taking)
            if j != n and len(w) == len(v)
        ]
        for p, p_id, _ in sorted(o for o in others if o[2] == label)[:k]:
            fit = sorted(o for o in others if o[2] != label and 30 * -p <= 100 * -o[0] <= 90 * -p)[:m]
            out += [(anchor, p_id, r, i, -p, -s) for r, (s, i, _) in enumerate(fit, 1)]
    return sorted((tuple(None if x == math.inf else x for x in o) for o in out), key=repr)


def mined(spark, rows):
    got = hn.hard_negatives(hn.prepared(table(spark, rows)))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, got.collect()), key=repr)


def vectors(n, dims, seed, digits=3):
    rng = random.Random(seed)
    return [(i, [round(rng.gauss(0, 0.2), digits) for _ in range(dims)], rng.randrange(3)) for i in range(n)]


def test_against_all_scores(spark):
    rows = vectors(900, 24, 1)
    assert mined(spark, rows) == expected(rows) != []


def test_ties_copies_and_few_components(spark):
    rows = vectors(300, 3, 2, digits=1) + [(100, [0.5, 0.5, 0.5], 1)] * 40 + [(None, [0.5, 0.5, 0.4], 2)] * 3
    assert mined(spark, rows) == expected(rows) != []


def test_rows_that_take_no_part(spark):
    rows = vectors(250, 8, 3)
    rows += [
        (300, None, 1), (400, [0.1] * 8, None), (500, [0.1] * 7 + [None], 1), (600, [0.1] * 7 + [math.nan], 1),
        (700, [math.inf] * 8, 1), (800, [0.2, 0.3], 1), (801, [0.2, 0.2], 1), (802, [0.1, 0.2], 2), (900, [], 1), (901, [], 1), (902, [], 0),
    ]
    got = mined(spark, rows)
    assert got == expected(rows)
    assert {r[0] for r in got} >= {0, 800, 900} and not {300, 400, 500, 600, 700} & {r[0] for r in got}


def test_scores_beyond_exact_doubles(spark):
    big = 3e5
    rows = [(i, [big * (x + 1) for x in v], l) for i, v, l in vectors(120, 6, 4)]
    rows += [(200, [1e30, 1.0], 0), (201, [1e30, 2.0], 0), (202, [1e29, 1.0], 1), (203, [-1e30, 1.0], 1)]
    assert mined(spark, rows) == expected(rows) != []


def test_many_groups_meet(spark, monkeypatch):
    rows = vectors(500, 12, 5)
    monkeypatch.setattr(hn, "GROUP_COMPONENTS", 100)
    assert mined(spark, rows) == expected(rows)


@pytest.mark.parametrize("rows", [[], [(1, [0.1], 1), (2, [0.2], 1)], [(100, [0.1], 1)], [(100, [0.1], 1), (1, [0.1], 1)]])
def test_nothing_to_return(spark, rows):
    assert mined(spark, rows) == []


def test_candidates_leave_before_the_last_column():
    """The bounds do their work: far rows are gone long before all columns are read."""
    import numpy as np

    rng = np.random.default_rng(6)
    matrix = np.floor(256 * rng.normal(0, 0.2, (4000, 64)) * np.linspace(3, 0.1, 64))
    ids = np.arange(4000)
    block = hn.Columns([(matrix, ids, ids, np.zeros(4000, bool), np.ones(4000, int))])
    left = []

    def still(lower, upper):
        live = upper >= hn.kth_best(lower, 5)
        left.append(int(live.sum()))
        return live

    alive, score = block.scan(matrix[7], ids != 7, still)
    truth = np.sort((matrix @ matrix[7])[ids != 7])[::-1]
    assert sorted(score.tolist(), reverse=True)[:5] == truth[:5].tolist()
    assert left[len(left) // 2] < 400
