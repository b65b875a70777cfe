"""Sums over what lies upstream, against walks, on forked networks and a long chain."""

import random

import pytest

from rillway.operators import rivers as R
from rillway.operators.iterate import chain_sums, tree_order


def above(links, of):
    """All that reaches ``of``, itself included."""
    seen, todo = {of}, [of]
    while todo:
        here = todo.pop()
        for s, d in links:
            if d == here and s not in seen:
                seen.add(s)
                todo.append(s)
    return seen


def tables(spark, links, nodes):
    parent = {}
    for s, d in links:
        parent[s] = min(parent.get(s, d), d)
    rivers = spark.createDataFrame([(n, parent.get(n)) for n in nodes], "river_id string, parent_id string")
    return rivers, spark.createDataFrame(links, "src string, dst string")


@pytest.mark.parametrize("seed", range(2))
def test_forks_count_once(spark, seed):
    rng = random.Random(seed)
    nodes = [f"r{k:02d}" for k in range(45)]
    links = {(nodes[k], rng.choice(nodes[:k])) for k in range(1, 45) if rng.random() < 0.9 for _ in range(rng.choice([1, 1, 1, 2, 3]))}
    links = sorted(links)
    rivers, flows = tables(spark, links, nodes)
    worth = {n: rng.randint(0, 50) for n in nodes}
    values = spark.createDataFrame([(n, worth[n], 1) for n in nodes if worth[n] % 5], "river_id string, w long, n long")
    got = {r.river_id: (r.w, r.n) for r in R.upstream_sums(rivers, flows, values, ["w", "n"]).collect()}
    want = {n: (sum(worth[m] for m in above(links, n) if worth[m] % 5), sum(1 for m in above(links, n) if worth[m] % 5)) for n in nodes}
    assert got == want
    net = R.Network(None, None, rivers, flows)
    assert {r.river_id: r.n_upstream for r in R.n_upstream(net).collect()} == {n: len(above(links, n)) - 1 for n in nodes}


def test_intervals_lie_in_one_another(spark):
    rng = random.Random(8)
    parent = {k: rng.randrange(k) if k % 9 else None for k in range(70)}
    rows = tree_order(spark.createDataFrame([(k, p) for k, p in parent.items()], "id long, next long")).collect()
    span = {r.id: (r.root, r.first, r.size) for r in rows}
    chain = lambda k: [k, *chain(parent[k])] if parent[k] is not None else [k]
    for a in parent:
        for b in parent:
            (ra, fa, _), (rb, fb, n) = span[a], span[b]
            assert (ra == rb and fb <= fa < fb + n) == (b in chain(a))
    for root in {r for r, _, _ in span.values()}:
        assert sorted(f for r, f, _ in span.values() if r == root) == list(range(span[root][2]))


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    from rillway.operators import iterate

    made = []
    real = iterate.written
    monkeypatch.setattr(iterate, "written", lambda df: made.append(real(df)) or made[-1])
    n = 5000
    chain = spark.range(n).selectExpr("id", "case when id > 0 then id - 1 end as next", "1L as n")
    got = {r.id: r.n for r in iterate.subtree_sums(chain, ["n"]).filter("id % 1000 = 0").collect()}
    assert got == {k: n - k for k in range(0, n, 1000)} and len(made) <= 15 and all(t.count() == n for t in made)
    sums = chain_sums(chain, "n").filter("id = 4999").first()
    assert (sums["last"], sums.n) == (0, 5000)
