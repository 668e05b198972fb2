"""Embedding near-dedup: a hierarchical navigable small-world graph per shard, every shard queried."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marktrace.llm.common import connected, key128, labels, stored
from marktrace.llm.words import mix

#: links per node and level (twice as many on the ground level), and the beam while building
LINKS, BUILD_BEAM = 12, 48
#: first search beam, nodes expanded at once, queries searched together, queries audited per shard and block
BEAM, EXPAND, TOGETHER, AUDITED = 16, 4, 512, 256
RECALL = 0.99
#: queries looked at for an audit, where few have neighbours
AUDITED_FROM = 4096
#: similarities in single precision are right within this
SLACK = 1e-4
#: a node met in a beam costs as much as this many in a product; similarities a scan holds at once
SCAN, SCANNED = 8, 2_000_000
#: vectors of a shard and of a block of queries, fewer where their dimension makes them larger than BYTES
ROWS, LEAST_SHARDS, BYTES = 50_000, 8, 64_000_000


class Graph:
    """Levels of a navigable small-world graph over unit vectors; nodes are added in batches."""

    def __init__(self, vectors: np.ndarray, links: int = LINKS):
        n = len(vectors)
        self.vectors, self.links = vectors, links
        uniform = (mix(np.arange(1, n + 1, dtype=np.uint64)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
        self.level = np.minimum(-np.log(uniform + 2.0**-54) / np.log(links), 8).astype(np.int64)
        self.level[:1] = max(int(self.level.max(initial=0)), 0)  # the entry node is on all levels
        self.near = [np.full((n, links * (2 if k == 0 else 1)), -1, dtype=np.int32) for k in range(int(self.level.max(initial=0)) + 1)]

    def build(self, beam: int = BUILD_BEAM) -> Graph:
        added, n = 1, len(self.vectors)
        while added < n:
            batch = np.arange(added, min(n, added + max(1, min(added, TOGETHER))))
            self._add(batch, beam)
            added = int(batch[-1]) + 1
        return self

    def _add(self, batch: np.ndarray, beam: int) -> None:
        q = self.vectors[batch]
        within = q @ q.T
        entry = np.zeros((len(batch), 1), dtype=np.int64)
        for k in range(len(self.near) - 1, -1, -1):
            there = self.level[batch] >= k
            ids, sims = self._beam(q, entry, beam if there.any() else 1, k)
            entry = ids
            if not there.any():
                continue
            rows = np.flatnonzero(there)
            # members of the same batch see each other: earlier ones only, so that each pair is considered once
            peer = np.where(np.arange(len(batch))[None, :] < np.arange(len(batch))[:, None], within, -np.inf)[rows][:, rows]
            take = np.argsort(-peer, axis=1)[:, : self.links]
            peer_sims = np.take_along_axis(peer, take, axis=1)
            peer_ids = np.where(peer_sims > -np.inf, batch[rows][take], -1)
            ids, sims = np.concatenate([ids[rows], peer_ids], axis=1), np.concatenate([sims[rows], peer_sims], axis=1)
            chosen = self._diverse(ids, sims, self.links)
            self.near[k][batch[rows], : chosen.shape[1]] = chosen
            self._link_back(batch[rows], chosen, k)

    def _diverse(self, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Per row up to ``most`` of the nearest ids, those first that are nearer to the row than to ones chosen before."""
        order = np.argsort(-np.where(ids >= 0, sims, -np.inf), axis=1)[:, : 3 * most]
        ids, sims = np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)
        ids = np.where(np.isfinite(sims), ids, -1)
        v = self.vectors[np.maximum(ids, 0)]
        between = np.matmul(v, v.transpose(0, 2, 1))
        kept = np.zeros(ids.shape, dtype=bool)
        for j in range(ids.shape[1]):
            blocked = (kept & (between[:, j, :] > sims[:, j : j + 1])).any(axis=1)
            kept[:, j] = ~blocked & (ids[:, j] >= 0) & (kept.sum(axis=1) < most)
        rank = np.argsort(np.where(kept, 0, np.where(ids >= 0, 1, 2)) * ids.shape[1] + np.arange(ids.shape[1]), axis=1)
        return np.take_along_axis(ids, rank, axis=1)[:, :most]

    def _link_back(self, nodes: np.ndarray, chosen: np.ndarray, k: int) -> None:
        source, target = np.repeat(nodes, chosen.shape[1]), chosen.reshape(-1)
        ok = target >= 0
        source, target = source[ok], target[ok]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        first = np.flatnonzero(np.r_[True, target[1:] != target[:-1]]) if len(target) else np.zeros(0, np.int64)
        owners, sizes = target[first], np.diff(np.append(first, len(target)))
        if not len(owners):
            return
        width = self.near[k].shape[1]
        fresh = np.full((len(owners), int(sizes.max())), -1, dtype=np.int64)
        fresh[np.repeat(np.arange(len(owners)), sizes), np.arange(len(target)) - np.repeat(first, sizes)] = source
        for i in range(0, len(owners), TOGETHER):
            some = owners[i : i + TOGETHER]
            ids = np.concatenate([self.near[k][some].astype(np.int64), fresh[i : i + TOGETHER]], axis=1)
            sims = np.where(ids >= 0, np.einsum("qd,qmd->qm", self.vectors[some], self.vectors[np.maximum(ids, 0)]), -np.inf)
            self.near[k][some] = self._fill(self._diverse(ids, sims, width), width)

    @staticmethod
    def _fill(ids: np.ndarray, width: int) -> np.ndarray:
        return np.pad(ids, ((0, 0), (0, width - ids.shape[1])), constant_values=-1)

    def _beam(self, q: np.ndarray, entry: np.ndarray, beam: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``beam`` nearest nodes found from ``entry`` on level ``k``, nearest first; -1 and -inf where fewer."""
        n_q, near = len(q), self.near[k]
        seen = np.zeros((n_q, len(self.vectors) + 1), dtype=bool)  # the last column stands for no node
        seen[:, -1] = True
        ids = np.full((n_q, beam), -1, dtype=np.int64)
        sims = np.full((n_q, beam), -np.inf, dtype=np.float32)
        opened = np.ones((n_q, beam), dtype=bool)
        ids, sims, opened = self._merge(q, np.arange(n_q), entry, seen, ids, sims, opened)
        active = np.arange(n_q)
        while len(active):
            best = np.where(opened[active], -np.inf, sims[active])
            pick = np.argpartition(-best, min(EXPAND, beam) - 1, axis=1)[:, : min(EXPAND, beam)]
            worth = np.take_along_axis(best, pick, axis=1) > -np.inf
            going = worth.any(axis=1)
            active, pick, worth = active[going], pick[going], worth[going]
            if not len(active):
                break
            now = np.where(worth, ids[active[:, None], pick], -1)
            opened[active[:, None], pick] = True
            around = np.where(now[:, :, None] >= 0, near[np.maximum(now, 0)], -1).reshape(len(active), -1)
            ids[active], sims[active], opened[active] = self._merge(q, active, around, seen, ids[active], sims[active], opened[active])
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)

    def _merge(self, q, rows, found, seen, ids, sims, opened):
        found = np.sort(np.where(found >= 0, found, len(self.vectors)), axis=1)
        new = ~seen[rows[:, None], found]
        new[:, 1:] &= found[:, 1:] != found[:, :-1]
        r, c = np.nonzero(new)
        node = found[r, c]
        seen[rows[r], node] = True
        value = np.full(found.shape, -np.inf, dtype=np.float32)
        value[r, c] = np.einsum("ij,ij->i", q[rows[r]], self.vectors[node])
        beam = ids.shape[1]
        all_ids = np.concatenate([ids, np.where(new, found, -1)], axis=1)
        all_sims = np.concatenate([sims, value], axis=1)
        all_opened = np.concatenate([opened, ~new], axis=1)
        top = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
        return tuple(np.take_along_axis(x, top, axis=1) for x in (all_ids, all_sims, all_opened))

    def scans(self, beam: int) -> bool:
        """Whether comparing a query with all nodes is no more work than searching with this beam."""
        return SCAN * 2 * self.links * beam >= len(self.vectors)

    def scan(self, q: np.ndarray, todo: np.ndarray, least: float):
        """Like ``steps`` for the queries ``todo``, each compared with all nodes."""
        step = max(1, min(TOGETHER, SCANNED // max(len(self.vectors), 1)))
        for i in range(0, len(todo), step):
            rows = todo[i : i + step]
            sims = q[rows] @ self.vectors.T
            r, c = np.nonzero(sims >= least)
            yield rows[r], c, sims[r, c]

    def steps(self, q: np.ndarray, least: float, beam: int):
        """Pairs (query, node) of similarity ``least`` or more with that similarity, some queries at a time.

        A beam full of such nodes is doubled for that query, until comparing it with all nodes is no more work.
        """
        todo = np.arange(len(q))
        n = len(self.vectors)
        while len(todo):
            beam, later = min(beam, n), []
            step = max(1, min(TOGETHER, 40_000_000 // (n + 1), 8_000_000 // beam))
            for i in range(0, len(todo), step):
                rows = todo[i : i + step]
                entry = np.zeros((len(rows), 1), dtype=np.int64)
                for k in range(len(self.near) - 1, 0, -1):
                    entry = self._beam(q[rows], entry, min(4, n), k)[0]
                ids, sims = self._beam(q[rows], entry, beam, 0)
                full = (sims[:, -1] >= least) & (beam < n)
                later.append(rows[full])
                r, c = np.nonzero((sims >= least) & ~full[:, None])
                yield rows[r], ids[r, c], sims[r, c]
            todo, beam = np.concatenate(later), beam * 2
            if self.scans(beam):
                yield from self.scan(q, todo, least)
                return

    def within(self, q: np.ndarray, least: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (query, node) of ``steps``."""
        pairs = [(a, b) for a, b, _ in self.steps(q, least, beam)]
        return tuple(np.concatenate(x) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64),) * 2


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _vectors(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks()
    return unit(flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim))


def audited_beam(graph: Graph, q32: np.ndarray, own: np.ndarray, loose: float, beam: int, recall: float) -> int | None:
    """The first beam, doubled from ``beam`` on, that passes an audit; None where all nodes should be compared.

    Audited are queries that have a true neighbour besides themselves (``own``, -1 for none): AUDITED of them,
    or as many as the first AUDITED_FROM queries in hashed order hold. The share ``recall`` of them must have
    all their neighbours, so that queries of a large group do not outweigh those of small ones.
    """
    order = np.argsort(mix(np.arange(1, len(q32) + 1, dtype=np.uint64)))[:AUDITED_FROM]
    rows, missing = np.zeros(0, np.int64), np.zeros((0, len(graph.vectors)), dtype=bool)
    for i in range(0, len(order), AUDITED):
        some = order[i : i + AUDITED]
        true = q32[some] @ graph.vectors.T >= loose + SLACK / 2
        inside = np.flatnonzero(own[some] >= 0)
        true[inside, own[some[inside]]] = False
        any_true = true.any(axis=1)
        rows, missing = np.concatenate([rows, some[any_true]])[:AUDITED], np.concatenate([missing, true[any_true]])[:AUDITED]
        if len(rows) == AUDITED:
            break
    while True:
        left = missing.copy()
        for a, b, _ in graph.steps(q32[rows], loose, beam):
            left[a, b] = False
        if (~left.any(axis=1)).sum() >= recall * len(rows):
            return beam
        beam *= 2
        if graph.scans(beam):
            return None


def search_steps(graph: Graph, q: np.ndarray, least: float, beam: int, recall: float, own: np.ndarray | None = None):
    """Pairs within ``least`` less SLACK with their similarity, some queries at a time: by the beam that passes the audit or against all nodes."""
    q32, loose = q.astype(np.float32), least - SLACK
    beam = audited_beam(graph, q32, np.full(len(q), -1) if own is None else own, loose, beam, recall)
    return graph.steps(q32, loose, beam) if beam else graph.scan(q32, np.arange(len(q)), loose)


def searched(graph: Graph, q: np.ndarray, least: float, beam: int, recall: float, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of ``search_steps``."""
    pairs = [(a, b) for a, b, _ in search_steps(graph, q, least, beam, recall, own)]
    return tuple(np.concatenate(x) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64),) * 2


def folded(graph: Graph, v: np.ndarray, node: np.ndarray, count: np.ndarray, q: np.ndarray, asked: np.ndarray, least: float, beam: int, recall: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Link counts of the queries ``asked``, all nodes concerned, and the place of each one's component among them.

    Pairs are verified, counted and merged into the components step by step; only one step's pairs are held.
    """
    at = np.searchsorted(node, asked)
    own = np.where(node[np.minimum(at, len(node) - 1)] == asked, at, -1)
    both = np.unique(np.concatenate([asked, node]))
    q_at, v_at, root = np.searchsorted(both, asked), np.searchsorted(both, node), np.arange(len(both))
    links = np.zeros(len(q), dtype=np.int64)
    for a, b, sims in search_steps(graph, q, least, beam, recall, own):
        linked = own[a] != b
        near = np.flatnonzero(sims < least + SLACK)  # single precision does not tell
        for i in range(0, len(near), 100_000):
            some = near[i : i + 100_000]
            linked[some] &= np.einsum("ij,ij->i", q[a[some]], v[b[some]]) >= least
        a, b = a[linked], b[linked]
        if len(a):
            first, last = int(a.min()), int(a.max()) + 1
            links[first:last] += np.bincount(a - first, weights=count[b], minlength=last - first).astype(np.int64)
            x, y = root[q_at[a]], root[v_at[b]]
            apart = x != y
            if apart.any():
                root = labels(len(both), x[apart], y[apart])[root]
    return links, both, root


def near_vectors(rows: DataFrame, least: float = 0.95, beam: int = BEAM, recall: float = RECALL, shard_rows: int = ROWS, least_shards: int = LEAST_SHARDS) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``rows(vec_id, embedding)``.

    Vectors of one dimension are linked when their cosine, in double precision, is ``least`` or more. A vector
    that is null, empty, zero or holds null or non-finite numbers has no links and is its own component.
    Equal vectors are one node with a count, so copies are linked without being paired. ``component_id`` is
    the smallest id that links lead to. Rows may repeat an id and are linked one by one; a row without id
    counts as a link of others, takes the smallest id of its component and is never kept. Other columns are
    not read.

    Nodes are dealt to shards by hash; each shard's graph is built by one task and queried with all nodes in
    blocks. Each pair of shard and block audits a sample of its queries that have neighbours against all nodes
    of the shard, doubling its beam until the share ``recall`` of them has all neighbours; a beam full of linked
    nodes is doubled for its query. Where a beam would be more work, queries are compared with all nodes. A task holds the
    pairs of one step of queries only, and returns link counts and at most one edge per node for the union.
    """
    number = F.col("embedding")
    sound = F.coalesce(F.forall(number, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(number, lambda x: x != 0), F.lit(False))
    read = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).withColumn("sound", sound)
    x, y = key128(number)
    good = read.where("sound").select("vec_id", "embedding", x.alias("x"), y.alias("y"))
    nodes = good.groupBy("x", "y").agg(F.first("embedding").alias("embedding"), F.min("vec_id").alias("lead"), F.count("*").alias("n"))
    nodes = stored(nodes.select(F.monotonically_increasing_id().alias("node"), "x", "y", "embedding", F.size("embedding").alias("dim"), "lead", "n"), "vector-nodes")
    size = {r["dim"]: r["n"] for r in nodes.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    most = {d: max(1, min(shard_rows, BYTES // (8 * d))) for d in size}
    shards = {d: max(min(least_shards, n), -(-n // most[d])) for d, n in size.items()}
    blocks = {d: -(-n // most[d]) for d, n in size.items()}

    def by_dim(counts: dict[int, int]):
        return F.element_at(F.create_map(*(F.lit(v) for p in (counts or {0: 1}).items() for v in p)), F.col("dim"))

    dealt = nodes.select("node", "embedding", "dim", "n", F.pmod(F.xxhash64("node"), by_dim(shards)).alias("shard"), F.pmod(F.xxhash64("node", F.lit(1)), by_dim(blocks)).alias("block"))
    kinds = ["nodes", "counts", "vectors", "level", "near"]

    def build(key, group):
        group = group.sort_by("node")
        dim = key[0].as_py()
        v = _vectors(group.column("embedding"), dim)
        g = Graph(v.astype(np.float32)).build()
        parts = [group.column("node").to_numpy(), group.column("n").to_numpy(), v, g.level, np.concatenate([a.reshape(-1) for a in g.near])]
        return pa.table({"dim": pa.array([dim], pa.int32()), "shard": pa.array([key[1].as_py()], pa.int64()), **{c: pa.array([p.tobytes()], pa.binary()) for c, p in zip(kinds, parts, strict=True)}})

    graphs = dealt.select("dim", "shard", "node", "embedding", "n").groupBy("dim", "shard").applyInArrow(build, "dim int, shard long, " + ", ".join(f"{c} binary" for c in kinds))
    graphs = stored(graphs, "vector-graphs")

    def query(key, left, right):
        empty = pa.table({c: pa.array([], pa.int64()) for c in "abn"})
        if not left.num_rows or not right.num_rows:
            return empty
        dim = key[0].as_py()
        get = {c: left.column(c)[0].as_buffer() for c in kinds}
        node, count, level = (np.frombuffer(get[c], dtype=np.int64) for c in ("nodes", "counts", "level"))
        v = np.frombuffer(get["vectors"], dtype=np.float64).reshape(-1, dim)
        graph = Graph.__new__(Graph)
        graph.vectors, graph.links, graph.level = v.astype(np.float32), LINKS, level
        flat, graph.near, at = np.frombuffer(get["near"], dtype=np.int32), [], 0
        for k in range(int(level.max()) + 1):
            width = LINKS * (2 if k == 0 else 1)
            graph.near.append(flat[at : at + len(v) * width].reshape(len(v), width))
            at += len(v) * width
        q, asked = _vectors(right.column("embedding"), dim), right.column("node").to_numpy()
        links, both, root = folded(graph, v, node, count, q, asked, least, beam, recall)
        child = np.flatnonzero(root != np.arange(len(both)))
        some = np.flatnonzero(links)
        none = np.full(len(some), -1)
        return pa.table({"a": np.concatenate([asked[some], both[child]]), "b": np.concatenate([none, both[root[child]]]), "n": np.concatenate([links[some], np.zeros(len(child), np.int64)])})

    per_block = graphs.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), (by_dim(blocks) - 1).cast("long"))))
    per_shard = dealt.select("dim", "block", "node", "embedding", F.explode(F.sequence(F.lit(0).cast("long"), (by_dim(shards) - 1).cast("long"))).alias("shard"))
    pairs = per_block.groupBy("dim", "shard", "block").cogroup(per_shard.groupBy("dim", "shard", "block")).applyInArrow(query, "a long, b long, n long")
    found = stored(pairs, "vector-links")
    roots = connected(found.where("b >= 0").select("a", "b"), "vectors")
    counted = found.where("b < 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    placed = nodes.select("node", "x", "y", "lead", "n").join(roots, "node", "left").join(counted, "node", "left").select("x", "y", "lead", F.coalesce("root", "node").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    placed = stored(placed, "vector-roots")
    named = stored(placed.groupBy("root").agg(F.min("lead").alias("component_id")), "vector-components")
    answer = stored(placed.join(named, "root").select("x", "y", "n_links", "component_id"), "vector-answers")
    linked = good.select("vec_id", "x", "y").join(answer, ["x", "y"]).select("vec_id", "n_links", "component_id")
    alone = read.where("NOT sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
