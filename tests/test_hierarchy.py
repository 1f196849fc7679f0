import random

import pytest
from conftest import rows

from palimpsest.operators.hierarchy import descendant_counts, descendants, hierarchy


def tree(spark, pairs, ids=None):
    ids = ids or sorted({x for p in pairs for x in p if x is not None})
    return spark.createDataFrame([(i,) for i in ids], "id bigint"), spark.createDataFrame(pairs, "id bigint, parent bigint")


def brute(pairs, ids):
    up = {}
    for i, p in pairs:
        if i in ids and p in ids:
            up[i] = min(p, up.get(i, p))
    out = {}
    for i in ids:
        seen, at = [], i
        while at in up and at not in seen:
            seen.append(at)
            at = up[at]
        if at in seen:
            out[i] = (up.get(i), min(seen[seen.index(at):]), -1, None)
        else:
            out[i] = (up.get(i), at, len(seen), [*seen, at])
    return out


@pytest.mark.parametrize(("seed", "small"), [(1, 0), (2, 40), (3, None)])
def test_random_forests_with_circles(spark, seed, small):
    rnd = random.Random(seed)
    ids = list(range(300))
    pairs = [(i, rnd.randrange(max(0, i - 3), i)) for i in ids[1:200]]  # long chains
    pairs += [(i, rnd.randrange(200, 300)) for i in range(200, 290)]  # circles
    n, e = tree(spark, pairs, ids)
    got = {r.id: (r.parent, r.root, r.depth, r.path) for r in hierarchy(n, e, paths=True, small=small).collect()}
    assert got == brute(pairs, set(ids))


def test_special_links(spark):
    pairs = [(1, 1), (2, 1), (3, 99), (4, None), (None, 4), (5, 6), (6, 5), (7, 8), (7, 9), (7, 8)]
    n, e = tree(spark, pairs, [1, 1, 2, 3, 4, 5, 6, 7, 8, 9, None])
    got = rows(hierarchy(n, e))
    assert got == rows(hierarchy(n, e, small=0)) == [(1, 1, 1, -1), (2, 1, 1, -1), (3, None, 3, 0), (4, None, 4, 0), (5, 6, 5, -1), (6, 5, 5, -1), (7, 8, 8, 1), (8, None, 8, 0), (9, None, 9, 0)]


def test_empty(spark):
    n, e = tree(spark, [], [None])
    assert rows(hierarchy(n, e, paths=True)) == []


def test_one_parent_of_a_third_and_a_long_chain(spark):
    pairs = [(i, 0) for i in range(1, 1000)] + [(i, i - 1) for i in range(2000, 2500)]
    n, e = tree(spark, pairs)
    out = hierarchy(n, e, paths=True).cache()
    assert out.where("root = 0 and depth = 1").count() == 999
    assert {r.id: r.n_descendants for r in descendant_counts(out).where("n_descendants > 400").collect()}[0] == 999
    assert out.where("id = 2499").head().depth == 500
    assert descendants(out).where("id = 1999").count() == 500


def brute_descendants(pairs, ids):
    up = {i: p for i, (p, *_) in brute(pairs, ids).items() if p is not None}
    out = set()
    for i in ids:
        at, k, seen = i, 0, {i}
        while at in up and up[at] not in seen:
            at, k = up[at], k + 1
            seen.add(at)
            out.add((at, i, k))
    return out


@pytest.mark.parametrize(("seed", "small"), [(1, 0), (2, None)])
def test_descendants_in_and_below_circles(spark, seed, small):
    rnd = random.Random(seed)
    ids = list(range(400))
    pairs = [(i, i + 1) for i in range(40)] + [(40, 0), (41, 41), (42, 43), (43, 42)]  # circles of 41, one and two
    pairs += [(i, rnd.randrange(max(0, i - 4), i)) for i in range(44, 200)]  # long tails below them
    pairs += [(i, rnd.randrange(200, 400)) for i in range(200, 390)]
    n, e = tree(spark, pairs, ids)
    out = hierarchy(n, e, paths=True, small=small).cache()
    want = brute_descendants(pairs, set(ids))
    got = [tuple(r) for r in descendants(out).collect()]
    assert len(got) == len(want) and set(got) == want
    counts = {r.id: r.n_descendants for r in descendant_counts(out).collect()}
    assert counts == {i: sum(a == i for a, _, _ in want) for i in ids}


def test_a_long_chain_and_a_star_in_one_task():
    import pandas as pd

    from palimpsest.operators.hierarchy import contract

    n = 100_000
    up = [None, *range(n - 1)] + [0] * n + [2 * n]
    df = pd.DataFrame({"n": range(2 * n + 1), "p": pd.array(up, "Int64"), "w": 1, "least": range(2 * n + 1), "via": None})
    got = contract(df.sample(frac=1.0, random_state=1), False).set_index("n")
    assert got.loc[n - 1].depth == n - 1 and (got.loc[n : 2 * n - 1].depth == 1).all() and (got.root[: 2 * n] == 0).all() and got.loc[2 * n].depth == -1
