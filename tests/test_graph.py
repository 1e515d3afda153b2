"""Graph searches against plain loops over random graphs, in one tree and in two side by side."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import graph


def links(seed, n, m):
    rng = random.Random(seed)
    return sorted({(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(m)})


def brute_paths(pairs, wanted, blocked, depth):
    after = {}
    for a, b in pairs:
        after.setdefault(a, set()).add(b)
    out = {}
    for a, b in wanted:
        if a == b:
            out[a, b] = [a]
            continue
        found, front = [], [[a]]
        for _ in range(depth):
            grown = [[*p, x] for p in front for x in after.get(p[-1], ()) if x not in p]
            found += [p for p in grown if p[-1] == b]
            front = [p for p in grown if p[-1] not in blocked and p[-1] != b]
        if found:
            out[a, b] = min(found, key=lambda p: (len(p), p))
    return out


@pytest.mark.parametrize("depth", [1, 3, 5])
def test_shortest_paths(spark, depth):
    pairs = links(depth, 14, 45) + [("n1", "n1")]
    nodes = [f"n{i}" for i in range(15)]
    wanted, blocked = list(itertools.product(nodes, nodes)), {"n2", "n5"}
    edges = spark.createDataFrame(pairs + pairs[:9], "from string, to string")
    got = graph.shortest_paths(edges, spark.createDataFrame(wanted + wanted[:3], "from string, to string"), spark.createDataFrame([(b,) for b in blocked], "node_id string"), depth).collect()
    assert {(r["from"], r["to"]): r["path"] for r in got} == brute_paths(pairs, wanted, blocked, depth)
    assert len(got) == len({(r["from"], r["to"]) for r in got}) and all(r["hops"] == len(r["path"]) - 1 for r in got)


def brute_discovery(pairs):
    after, out = {}, set()
    for a, b in sorted(set(pairs)):
        after.setdefault(a, []).append(b)
    for start in after:
        depth, todo = {start: 0}, [start]
        while todo:
            at = todo.pop()
            for b in after.get(at, []):
                if b not in depth:
                    depth[b] = depth[at] + 1
                    todo.append(b)
        out |= {(start, b, d) for b, d in depth.items()}
    return out


def test_claim_distances_by_start_and_tree(spark):
    one, two = links(1, 30, 70), links(2, 30, 40) + [(f"c{i}", f"c{i + 1}") for i in range(12)]
    rows = [("x", *p) for p in one] + [("y", *p) for p in two]
    claims = spark.createDataFrame(rows + rows[:5], "tree string, from string, to string")
    got = graph.claim_distances(claims)
    assert got.columns == ["tree", "from", "to", "hops"]
    assert sorted(map(tuple, got.collect())) == sorted([("x", *r) for r in brute_discovery(one)] + [("y", *r) for r in brute_discovery(two)])
    alone = graph.claim_distances(claims.where("tree = 'y'").drop("tree"))
    assert sorted(map(tuple, alone.collect())) == sorted(brute_discovery(two))
    some = graph.claim_distances(claims, spark.createDataFrame([("y", "c3"), ("y", "c3"), ("x", "c3"), ("x", "nowhere")], "tree string, from string"))
    assert sorted(map(tuple, some.collect())) == sorted(("y", *r) for r in brute_discovery(two) if r[0] == "c3")
    assert graph.claim_distances(claims.limit(0)).count() == 0


def test_ten_thousand_claims(spark):
    rng = random.Random(4)
    pairs = [(f"g{g}_{rng.randrange(50)}", f"g{g}_{rng.randrange(50)}") for g in range(100) for _ in range(100)]
    got = graph.claim_distances(spark.createDataFrame(pairs, "from string, to string")).agg(F.count("*").alias("n"), F.sum("hops").alias("s")).first()
    want = brute_discovery(pairs)
    assert (got["n"], got["s"]) == (len(want), sum(r[2] for r in want))
