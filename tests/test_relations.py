"""Review groups against a plain reimplementation of the sequential rule."""

from __future__ import annotations

import random

import pytest

from factloom.operators import review
from factloom.plans import catalogue


def plain_groups(rows):
    """Rows (review_ord, diff_id, reason, old_id, old_place), all taken together, one review after another."""
    reviews = {}
    for review_ord, diff_id, reason, old_id, _ in sorted(rows, key=lambda r: (r[0], r[1], r[4], r[3])):
        olds = reviews.setdefault(diff_id, (reason, []))[1]
        if old_id not in olds:
            olds.append(old_id)
    out, taken, by_old = [], set(), {}
    for diff_id, (reason, olds) in reviews.items():
        if reason == "MANY_TO_ONE" and len(olds) > 1:
            out.append((f"REL-{diff_id}", diff_id))
            taken.add(diff_id)
        else:
            for old_id in olds:
                by_old.setdefault(old_id, []).append(diff_id)
    for old_id, members in by_old.items():
        free = [m for m in members if m not in taken]
        if len(free) > 1:
            out += [(f"REL-{old_id}", m) for m in free]
            taken.update(free)
    return sorted(out + [(f"REL-{d}", d) for d in reviews if d not in taken])


def lines(spark, tmp_path, rows):
    """A lineitem table of (l_orderkey, l_linenumber, l_partkey, l_suppkey), and its candidates."""
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    return [(o, f"DIFF-{o}", "ONE_TO_MANY" if o % 3 else "MANY_TO_ONE", f"OLD-{p}", n) for o, n, p, _ in rows]


def test_query_takes_every_line(spark, tmp_path):
    rows = [(o, n, 100 * o + n, 1) for o in (1, 2, 3) for n in range(1, 4)] + [(1, 4, 7, 1), (2, 5, 7, 1), (4, 4, 8, 1), (5, 6, 8, 1), (6, 7, 9, 1)]
    want = plain_groups(lines(spark, tmp_path, rows))
    assert {("REL-OLD-7", "DIFF-2"), ("REL-OLD-8", "DIFF-5"), ("REL-DIFF-6", "DIFF-6")} <= set(want)
    assert sorted(map(tuple, catalogue.relation_groups(spark, str(tmp_path)).collect())) == want


def test_query_groups_across_suppliers(spark, tmp_path):
    rng = random.Random(5)
    rows = [(o, n, rng.randrange(40), rng.randrange(9)) for o in range(60) for n in range(1, rng.randrange(2, 8))]
    want = plain_groups(lines(spark, tmp_path, rows))
    assert sorted(map(tuple, catalogue.relation_groups(spark, str(tmp_path)).collect())) == want


@pytest.mark.parametrize("small", [0, 20, 10_000])
@pytest.mark.parametrize("shape", ["mixed", "chain", "hot", "empty"])
def test_rounds_equal_one_task(spark, shape, small):
    rng = random.Random(len(shape))
    rows = []
    if shape == "mixed":
        rows = [(k, f"D{k}", rng.choice(["MANY_TO_ONE", "ONE_TO_MANY", "ONE_TO_MANY"]), f"o{rng.randrange(60)}", n) for k in range(80) for n in range(rng.randrange(1, 5))]
    elif shape == "chain":
        rows = [(k, f"D{k}", "ONE_TO_MANY", f"o{k + n}", n) for k in range(12) for n in range(2)]
    elif shape == "hot":
        rows = [(k, f"D{k}", "ONE_TO_MANY", "hot" if n == k % 3 else f"o{rng.randrange(30)}", n) for k in range(60) for n in range(3)]
    d = spark.createDataFrame(rows, "review_ord long, diff_id string, reason string, old_id string, old_place int")
    assert sorted(map(tuple, review.relation_groups(d, small).collect())) == plain_groups(rows)
