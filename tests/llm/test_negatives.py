"""Hard negatives against brute force, and Strassen's products against numpy's."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from delimlake.llm import negatives

SCHEMA = "vec_id long, label int, vector array<long>"


@pytest.mark.parametrize("shape", [(1, 1, 1), (5, 7, 3), (33, 37, 41), (64, 64, 64), (100, 1, 90)])
def test_strassen_is_exact_with_wrapping_sums(shape):
    m, k, n = shape
    r = np.random.default_rng(m)
    a, b = r.integers(-(2**62), 2**62, (m, k)), r.integers(-(2**62), 2**62, (k, n))
    assert (negatives.strassen(a, b, 2) == a @ b).all()


def brute(rows, is_anchor):
    """The mined rows, by comparing everything."""
    rows = [r for r in rows if None not in r]
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for aid, alabel, av in rows:
        if not is_anchor(aid):
            continue
        same = sorted((-score(av, v), i) for i, lab, v in rows if lab == alabel and i != aid)[:5]
        other = sorted((-score(av, v), i) for i, lab, v in rows if lab != alabel)
        for p, pid in same:
            for rank, (s, nid) in enumerate([x for x in other if 80 * -p <= 100 * -x[0] <= 100 * -p][:5], 1):
                out.append((aid, pid, rank, nid, -p, -s))
    return sorted(out)


def mined(spark, rows, every=3, schema=SCHEMA):
    got = negatives.mine_negatives(spark.createDataFrame(rows, schema), F.col("vec_id") % every == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in got.collect())


def test_against_brute_force_in_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(negatives, "ANCHORS", 20)
    monkeypatch.setattr(negatives, "BLOCK", 40)
    monkeypatch.setattr(negatives, "STRIP", 16)
    r = np.random.default_rng(1)
    # Small whole components make many ties; one label holds a third of all rows.
    rows = [(i, int(r.choice([0, 0, 1, 2, 3])), r.integers(-3, 4, 6).tolist()) for i in range(200)]
    rows += [rows[6], rows[9], rows[10], rows[11]]  # repeated anchors and candidates
    want = brute(rows, lambda i: i % 3 == 0)
    assert len(want) > 500
    assert mined(spark, rows) == want


def test_nulls_lengths_few_rows_and_windows(spark):
    rows = [
        (0, 1, [10, 0]),
        (1, 1, [9]),  # a short vector: its missing components are zero
        (2, 2, [9, 5, 7]),
        (3, 2, [7, 0]),  # 70 of a positive's 90: below the window
        (4, 2, [10, 0]),  # above the window
        (5, None, [9, 0]),
        (None, 2, [9, 0]),
        (6, 2, None),
        (9, 3, [-5, -5]),  # an anchor without positives
        (12, 4, [5, 5]),
        (13, 4, [-5, -5]),  # a positive score below 0: no window
        (14, 5, []),
    ]
    want = brute(rows, lambda i: i % 3 == 0)
    assert (0, 1, 1, 2, 90, 90) in want and not any(r[0] in (9, 12) for r in want)
    assert mined(spark, rows) == want


def test_empty_table_and_clashing_columns(spark):
    assert mined(spark, []) == []
    schema = SCHEMA + ", row long, id string, v string, x int, y int, anchor string, rank int"
    rows = [(0, 1, [4, 4]), (1, 1, [4, 3]), (2, 2, [4, 2])]
    assert mined(spark, [(*r, 1, "a", "b", 2, 3, "c", 4) for r in rows], schema=schema) == brute(rows, lambda i: i % 3 == 0) != []


def test_far_scores_keep_their_digits(spark):
    big = 2**31
    rows = [(0, 1, [big, 1]), (1, 1, [big, 1]), (2, 2, [big, 0]), (4, 2, [big - 1, 0]), (5, 2, [big, 2])]
    assert mined(spark, rows) == brute(rows, lambda i: i % 3 == 0)
