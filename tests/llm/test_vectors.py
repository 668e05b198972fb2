import tracemalloc

import numpy as np

from marktrace.llm.hnsw import Graph, folded, near_vectors, searched, unit

NAN, INF = float("nan"), float("inf")


def brute(rows, least=0.95):
    n = len(rows)
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v) for _, v in rows]
    root, links = list(range(n)), [0] * n

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(n):
        for b in range(a):
            if ok[a] and ok[b] and len(rows[a][1]) == len(rows[b][1]):
                x, y = (np.array(rows[i][1], dtype=np.float32).astype(np.float64) for i in (a, b))
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                    links[a] += 1
                    links[b] += 1
                    root[find(a)] = find(b)
    ids = {}
    for a in range(n):
        ids.setdefault(find(a), []).append(rows[a][0])
    name = {k: min((i for i in v if i is not None), default=None) for k, v in ids.items()}
    return sorted(((rows[a][0], links[a], name[find(a)], rows[a][0] is not None and rows[a][0] == name[find(a)]) for a in range(n)), key=str)


def vectors(n=250):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(n, 8))
    base[40:110] = base[40] + rng.normal(size=(70, 8)) * 0.12
    base[110:130] = base[3]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(base.astype(np.float32))]
    odd = [None, [], [0.0] * 8, [None] + [1.0] * 7, [NAN] + [1.0] * 7, [INF] + [1.0] * 7, [1.0, 2.0], [2.0, 4.0], [1e-30] * 8]
    return rows + [(1000 + i, v) for i, v in enumerate(odd)] + [(None, rows[3][1]), (3, rows[3][1]), (4, rows[50][1]), (None, None)]


def run(spark, rows, **k):
    df = spark.createDataFrame([(i, v, 0, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, n_links int, node string").repartition(4)
    return sorted((tuple(r) for r in near_vectors(df, **k).select("vec_id", "n_links", "component_id", "kept").collect()), key=str)


def test_against_brute_force(spark):
    assert run(spark, vectors()) == brute(vectors())


def test_many_shards_and_blocks(spark):
    assert run(spark, vectors(), shard_rows=30, beam=2) == brute(vectors())


def test_empty_table(spark):
    assert run(spark, []) == [] and run(spark, [(1, None)]) == [(1, 0, 1, True)]


def test_graph_finds_large_groups():
    rng = np.random.default_rng(2)
    v = unit(np.concatenate([rng.normal(size=(1500, 16)), rng.normal(size=(1, 16)) + 0.1 * rng.normal(size=(400, 16))])).astype(np.float32)
    a, _ = Graph(v).build().within(v, 0.95, 16)
    true = (v @ v.T >= 0.95).sum()
    assert 0.99 * true <= len(a) <= true


def test_audit_sees_small_groups_beside_a_hot_one():
    rng = np.random.default_rng(4)
    hot, lone = rng.normal(size=(1, 32)) + 0.02 * rng.normal(size=(300, 32)), rng.normal(size=(200, 32))
    v, q = unit(np.concatenate([hot, lone])), unit(np.concatenate([hot[:150] + 0.01, lone + 0.01]))
    graph = Graph(v.astype(np.float32))
    ring = np.where(np.arange(500)[:, None] < 300, (np.arange(500)[:, None] + np.arange(1, 25)) % 300, -1)
    graph.near = [ring.astype(np.int32)]  # no link leads from the hot group to other nodes
    a, b = searched(graph, q, 0.95, 16, 0.99)
    assert {(i, i + 150) for i in range(150, 350)} <= set(zip(a.tolist(), b.tolist(), strict=True))


def test_pairs_of_a_hot_group_are_not_held():
    rng = np.random.default_rng(5)
    v = unit(np.concatenate([rng.normal(size=(1, 8)) + 0.01 * rng.normal(size=(6000, 8)), -np.eye(8)]))
    node, graph = np.arange(len(v)) * 3, Graph(v.astype(np.float32)).build(12)
    tracemalloc.start()
    links, both, root = folded(graph, v, node, np.full(len(v), 2), v, node, 0.95, 16, 0.99)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    true = v @ v.T >= 0.95
    assert (links == 2 * (true.sum(axis=1) - 1)).all() and (both == node).all() and (root[:6000] == 0).all()
    assert peak < 8 * true.sum()  # one number per pair alone would be as much
