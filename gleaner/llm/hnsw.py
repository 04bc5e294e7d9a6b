"""Embedding near-duplicates by hierarchical navigable small-world graphs, one per shard.

Equal vectors are one node. Nodes are dealt to shards by hash; one task builds a shard's graph
from a bounded number of vectors. Every node queries every shard in bounded blocks, and always
through the graph. A block's beam is doubled until audits pass: the exact links of a bounded draw
of its queries, apart for few and for many links, and planted queries that lie at the least cosine
from a vector of the shard, which need no links among the given vectors. A query whose whole beam
is linked goes on from its linked nodes alone, so no number of links is a cap and the work follows
that number. Cosines of what is found are verified in double precision.

Tasks write pairs only where a query has few links in a shard; else the number of its links. With
them go the edges of a spanning forest of all links, whose union gives the components. So rows
grow with vectors x shards, not with the square of a group. The links within a group are still
counted one by one.
"""

from __future__ import annotations

import pickle
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import components
from gleaner.session import write_table

COSINE = 0.9
# Vectors of one graph, and queries of one task; both bound a task's memory.
SHARD_VECTORS = 65_536
BLOCK_QUERIES = 16_384
MIN_SHARDS = 4
MOST_TASKS = 20_000
NEIGHBOURS = 12
BUILD_BEAM = 48
BEAM = 64
# Queries of a block whose exact links are looked up for its audit, and queries planted for it.
AUDITED = 256
PLANTED = 512
RECALL = 0.995
# From so many links in one shard on, a query counts them and names none.
DENSE = 64
# A search that goes on beyond its beam expands nodes down to so much below the least cosine.
SLACK = 0.05
# Pairs whose vectors are gathered at a time.
GATHERED = 65_536
# (query, vector) pairs a task holds at a time: what was seen takes a byte each, links some 40.
HELD_PAIRS = 8_000_000
BATCH = 512
EXPANDED = 4

# Tasks get this module's functions with the job; executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision; scaled first, so that squares neither overflow nor vanish."""
    scaled = vectors.astype(np.float64)
    scaled /= np.abs(scaled).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _singles(vectors: np.ndarray) -> np.ndarray:
    """`unit` in single precision, with double precision for some rows at a time."""
    out = np.empty(vectors.shape, dtype=np.float32)
    for start in range(0, len(out), GATHERED // 8):
        out[start : start + GATHERED // 8] = unit(vectors[start : start + GATHERED // 8])
    return out


class Graph:
    """A layered neighbour graph over unit vectors; batches of queries move through it in step."""

    def __init__(self, vectors: np.ndarray):
        self.x = _singles(vectors)
        n = len(self.x)
        rng = np.random.default_rng(n)
        levels = np.minimum((-np.log(1.0 - rng.random(n)) / np.log(NEIGHBOURS)).astype(int), 6)
        # Higher nodes come first: they are the entry of every later insertion.
        self.order = np.argsort(-levels, kind="stable")
        self.levels = levels
        width = [2 * NEIGHBOURS] + [NEIGHBOURS] * int(levels.max(initial=0))
        self.near = [np.full((n, w), -1, dtype=np.int32) for w in width]
        rank = np.empty(n, dtype=np.int64)
        rank[self.order] = np.arange(n)
        # The nearest node that was there before.
        self.older, self.rank = np.full(n, -1, dtype=np.int32), rank
        done = 0
        while done < n:
            batch = self.order[done : done + min(BATCH, max(32, done))]
            self._insert(batch, done)
            done += len(batch)
        self._reach()

    def _reach(self) -> None:
        """Choosing among back links can leave a node that nobody names. A node that the older one next to it has
        dropped joins a list: the older one names the first of its list, each of them the one after. So every node
        is reached from the entry, and two more columns are enough for any number of them."""
        young = np.flatnonzero(self.older >= 0)
        lost = young[(self.near[0][self.older[young]] != young[:, None]).all(axis=1)]
        by = self.older[lost]
        lost = lost[np.lexsort((-np.einsum("kd,kd->k", self.x[lost], self.x[by]), by))]
        first = np.flatnonzero(np.diff(self.older[lost], prepend=-1))
        more = np.full((len(self.x), 2), -1, dtype=np.int32)
        more[self.older[lost[first]], 0] = lost[first]
        after = np.setdiff1d(np.arange(len(lost)), first)
        more[lost[after - 1], 1] = lost[after]
        self.near[0] = np.concatenate((self.near[0], more), axis=1)
        del self.older, self.rank

    def _insert(self, batch: np.ndarray, done: int) -> None:
        own = self.x[batch]
        among = own @ own.T
        np.fill_diagonal(among, -2)
        for level in range(len(self.near)):
            here = np.flatnonzero(self.levels[batch] >= level)
            if not len(here):
                continue
            mates = np.where(self.levels[batch][None, :] >= level, among[here], -2)
            k = min(BUILD_BEAM, mates.shape[1])
            top = np.argpartition(-mates, k - 1, axis=1)[:, :k]
            ids, sims = batch[top].astype(np.int32), np.take_along_axis(mates, top, axis=1)
            if done:
                older_ids, older_sims, *_ = self.search(own[here], BUILD_BEAM, level)
                ids, sims = np.concatenate((ids, older_ids), axis=1), np.concatenate((sims, older_sims), axis=1)
            if not level:
                before = np.where((ids >= 0) & (self.rank[ids] < self.rank[batch[here]][:, None]), sims, -3)
                best = before.argmax(axis=1)[:, None]
                known = np.take_along_axis(before, best, axis=1) > -3
                self.older[batch[here]] = np.where(known, np.take_along_axis(ids, best, axis=1), -1)[:, 0]
            self._link(batch[here], ids, sims, level)

    def _link(self, nodes: np.ndarray, ids: np.ndarray, sims: np.ndarray, level: int) -> None:
        chosen = self._choose(ids, sims, level)
        self.near[level][nodes] = chosen
        # Back links: the new neighbours of each old node, chosen again among old and new.
        source, target = np.repeat(nodes, chosen.shape[1]), chosen.ravel()
        source, target = source[target >= 0], target[target >= 0]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        told, first, counts = np.unique(target, return_index=True, return_counts=True)
        width = self.near[level].shape[1]
        for start in range(0, len(told), BATCH):
            some, at, n = told[start : start + BATCH], first[start : start + BATCH], counts[start : start + BATCH]
            extra = np.full((len(some), int(n.max())), -1, dtype=np.int32)
            mask = np.arange(extra.shape[1])[None, :] < n[:, None]
            extra[mask] = np.concatenate([source[a : a + c] for a, c in zip(at, n)])
            ids = np.concatenate((self.near[level][some], extra), axis=1)
            sims = np.where(ids >= 0, np.einsum("bkd,bd->bk", self.x[np.maximum(ids, 0)], self.x[some]), -2)
            if ids.shape[1] > 4 * width:
                best = np.argpartition(-sims, 4 * width, axis=1)[:, : 4 * width]
                ids, sims = np.take_along_axis(ids, best, axis=1), np.take_along_axis(sims, best, axis=1)
            self.near[level][some] = self._choose(ids, sims, level)

    def _choose(self, ids: np.ndarray, sims: np.ndarray, level: int) -> np.ndarray:
        """The nearest that are nearer to the node than to any chosen one, then the nearest others."""
        order = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)
        width = self.near[level].shape[1]
        found = self.x[np.maximum(ids, 0)]
        between = np.einsum("bid,bjd->bij", found, found)
        valid = (ids >= 0) & (sims > -2)
        same = (ids[:, :, None] == ids[:, None, :]) & np.tri(ids.shape[1], k=-1, dtype=bool)[None]
        valid &= ~same.any(axis=2)
        taken = np.zeros_like(valid)
        for i in range(ids.shape[1]):
            hidden = (taken[:, :i] & (between[:, i, :i] > sims[:, i, None])).any(axis=1)
            taken[:, i] = valid[:, i] & ~hidden & (taken[:, :i].sum(axis=1) < width)
        rank = np.where(taken, 0, np.where(valid, 1, 2))
        first = np.argsort(rank, axis=1, kind="stable")[:, :width]
        out = np.where(np.take_along_axis(rank, first, axis=1) < 2, np.take_along_axis(ids, first, axis=1), -1)
        if out.shape[1] < width:
            out = np.pad(out, ((0, 0), (0, width - out.shape[1])), constant_values=-1)
        return out.astype(np.int32)

    def search(self, asked: np.ndarray, beam: int, bottom: int = 0, low: float = 2.0) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
        """(ids, cosines, seen, met): the `beam` best found for each query on layer `bottom`, best first, -1
        where fewer; which vectors each query has seen; and arrays (query, id, cosine) of all met with a cosine of `low`."""
        n = len(asked)
        at = np.full(n, self.order[0])
        sim = asked @ self.x[self.order[0]]
        for level in range(len(self.near) - 1, bottom, -1):
            moving = np.arange(n)
            while len(moving):
                near = self.near[level][at[moving]]
                sims = np.where(near >= 0, np.einsum("bkd,bd->bk", self.x[np.maximum(near, 0)], asked[moving]), -2)
                best = sims.argmax(axis=1)
                top = sims[np.arange(len(moving)), best]
                better = top > sim[moving]
                moved = moving[better]
                at[moved], sim[moved] = near[better, best[better]], top[better]
                moving = moved
        ids = np.full((n, beam), -1, dtype=np.int32)
        sims = np.full((n, beam), -2, dtype=np.float32)
        spent = np.ones((n, beam), dtype=bool)
        ids[:, 0], sims[:, 0], spent[:, 0] = at, sim, False
        seen = np.zeros((n, len(self.x)), dtype=bool)
        seen[np.arange(n), at] = True
        first = np.flatnonzero(sim >= low)
        met = [(first, at[first], sim[first])]
        rows = np.arange(n)
        while len(rows):
            order = np.argsort(spent[rows], axis=1, kind="stable")[:, :EXPANDED]
            open_ = ~np.take_along_axis(spent[rows], order, axis=1)
            picks = np.where(open_, np.take_along_axis(ids[rows], order, axis=1), -1)
            spent[rows[:, None], order] = True
            rows, picks = rows[open_[:, 0]], picks[open_[:, 0]]
            if not len(rows):
                break
            near = np.where(picks[:, :, None] >= 0, self.near[bottom][np.maximum(picks, 0)], -1).reshape(len(rows), -1)
            near.sort(axis=1)
            fresh = (near >= 0) & ~seen[rows[:, None], np.maximum(near, 0)]
            fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
            where = np.nonzero(fresh)
            seen[rows[where[0]], near[where]] = True
            found = np.full(near.shape, -2, dtype=np.float32)
            found[where] = np.einsum("kd,kd->k", self.x[near[where]], asked[rows[where[0]]])
            hit = np.nonzero(found >= low)
            met.append((rows[hit[0]], near[hit], found[hit]))
            all_ids = np.concatenate((ids[rows], np.where(fresh, near, -1)), axis=1)
            all_sims = np.concatenate((sims[rows], found), axis=1)
            all_spent = np.concatenate((spent[rows], ~fresh), axis=1)
            best = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
            ids[rows] = np.take_along_axis(all_ids, best, axis=1)
            sims[rows] = np.take_along_axis(all_sims, best, axis=1)
            spent[rows] = np.take_along_axis(all_spent, best, axis=1)
        return ids, sims, seen, met

    def within(self, asked: np.ndarray, beam: int, low: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, id) of all found with a cosine of `low` or more, once each, by query; all of some queries at a time,
        so that no group of links is held whole. A beam that is full has let ids go: the search goes on from those
        of at least nearly that cosine, and expands no others."""
        n, edge = len(self.x), low - SLACK
        step = max(1, min(BATCH, HELD_PAIRS // n, 4_000_000 // beam))
        for start in range(0, len(asked), step):
            some = asked[start : start + step]
            ids, sims, seen, met = self.search(some, beam, 0, edge)
            rows, found, scores = (np.concatenate(x) for x in zip(*met))
            done = (np.arange(len(some))[:, None] * n + ids)[sims >= edge]
            keys = rows.astype(np.int64) * n + found
            out = [keys[scores >= low]]
            todo = keys[~np.isin(keys, done)] if len(keys) > len(done) else keys[:0]
            while len(todo):
                now, todo = todo[:GATHERED], [todo[GATHERED:]]
                near = self.near[0][now % n].astype(np.int64)
                near = np.where(near >= 0, now[:, None] // n * n + near, -1).ravel()
                near = near[near >= 0]
                near = np.unique(near[~seen.ravel()[near]])
                seen.ravel()[near] = True
                for at in range(0, len(near), GATHERED):
                    part = near[at : at + GATHERED]
                    scores = np.einsum("kd,kd->k", self.x[part % n], some[part // n])
                    out.append(part[scores >= low])
                    todo.append(part[scores >= edge])
                todo = np.concatenate(todo)
            keys = np.sort(np.concatenate(out))
            yield start + keys // n, keys % n


class Audit:
    """What a beam has to find: the exact links of drawn queries, besides themselves, and the origins of
    planted ones. `own` are the queries' places in the graph, -1 outside."""

    def __init__(self, graph: Graph, asked: np.ndarray, own: np.ndarray, least: float):
        rng = np.random.default_rng(len(asked))
        n, d = graph.x.shape
        drawn = rng.permutation(len(asked))[:AUDITED]
        near = np.concatenate([asked[drawn[i : i + 32]] @ graph.x.T >= least for i in range(0, len(drawn), 32)])
        at = np.flatnonzero(own[drawn] >= 0)
        near[at, own[drawn][at]] = False
        linked = np.flatnonzero(near.any(axis=1))
        # A dense group's many links, or many queries, must not outweigh those of small groups.
        self.few = near[linked].sum(axis=1) < BEAM
        # A planted query lies a little above the least cosine from its origin, in a random direction.
        origin = rng.permutation(n)[:PLANTED]
        aside = rng.normal(size=(len(origin), d)).astype(np.float32)
        aside -= np.einsum("kd,kd->k", aside, graph.x[origin])[:, None] * graph.x[origin]
        length = np.linalg.norm(aside, axis=1, keepdims=True)
        cosine = np.float32(min(1.0, least + 1e-3))
        planted = np.where(length > 1e-6, cosine * graph.x[origin] + np.sqrt(1 - cosine**2) * aside / np.maximum(length, 1e-6), graph.x[origin])
        self.graph, self.low = graph, least - 1e-4
        self.asked = np.concatenate((asked[drawn[linked]], planted)).astype(np.float32)
        self.wanted, self.origin = near[linked], origin
        self.kind = np.concatenate((np.where(self.few, 0, 1), np.full(len(origin), 2)))

    def recall(self, beam: int) -> list[float]:
        """For queries of few links, of many, and planted ones: the mean share found; 1 where there are none."""
        shares, n_linked = np.zeros(len(self.asked)), len(self.wanted)
        for query, found in self.graph.within(self.asked, beam, self.low):
            real = query < n_linked
            shares += np.bincount(query[real], self.wanted[query[real], found[real]], minlength=len(shares))
            query, found = query[~real], found[~real]
            shares[query[self.origin[query - n_linked] == found]] = 1
        shares[:n_linked] /= self.wanted.sum(axis=1)
        return [float(shares[self.kind == k].mean()) if (self.kind == k).any() else 1.0 for k in range(3)]


def wide_enough(graph: Graph, asked: np.ndarray, least: float, own: np.ndarray) -> tuple[int, list[float]]:
    """The beam that passes the audit, and its recall."""
    audit, beam = Audit(graph, asked, own, least), min(BEAM, len(graph.x))
    recall = audit.recall(beam)
    while min(recall) < RECALL and beam < len(graph.x):
        beam = min(2 * beam, len(graph.x))
        recall = audit.recall(beam)
    return beam, recall


def linked(graph: Graph, asked: np.ndarray, least: float, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int, list[float]]:
    """(query, id) of all found with a cosine of about `least` or more, the beam used and its audited recall."""
    own = np.full(len(asked), -1) if own is None else own
    beam, recall = wide_enough(graph, asked, least, own)
    queries, found = zip(*graph.within(asked, beam, least - 1e-4))
    return np.concatenate(queries), np.concatenate(found), beam, recall


def _build(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("node")
    vectors = np.stack(rows["vector"].to_numpy())
    parts = vars(Graph(vectors))
    # Unit vectors are made again from the given ones, and upper layers from the rows of their few nodes.
    del parts["x"]
    parts["near"][1:] = [(at := np.flatnonzero((layer >= 0).any(axis=1)), layer[at]) for layer in parts["near"][1:]]
    blob = pickle.dumps((rows["node"].to_numpy(), rows["copies"].to_numpy(), vectors, parts))
    return pd.DataFrame({"dim": [rows["dim"].iloc[0]], "shard": [rows["shard"].iloc[0]], "graph": [blob]})


def _unpacked(vectors: np.ndarray, parts: dict) -> Graph:
    graph = Graph.__new__(Graph)
    graph.__dict__.update(parts, x=_singles(vectors))
    for level, (at, layer) in enumerate(graph.near[1:], 1):
        graph.near[level] = np.full((len(vectors), layer.shape[1]), -1, dtype=np.int32)
        graph.near[level][at] = layer
    return graph


def _joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """`root`, the smallest member of each one's component, after the links (a, b)."""
    while len(a):
        a, b = root[a], root[b]
        apart = a != b
        a, b = a[apart], b[apart]
        root = root.copy()
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root != root[root]).any():
            root = root[root]
    return root


def _met(least: float):
    def query(key: tuple, graphs: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(graphs) or not len(rows):
            return pd.DataFrame({name: np.zeros(0) for name in FOUND})
        nodes, copies, vectors, parts = pickle.loads(graphs["graph"].iloc[0])
        graph = _unpacked(vectors, parts)
        rows = rows.sort_values("node")
        asked, own = unit(np.stack(rows["vector"].to_numpy())), rows["node"].to_numpy()
        # Nodes of a graph are in order.
        at = np.minimum(np.searchsorted(nodes, own), len(nodes) - 1)
        places = np.where(nodes[at] == own, at, -1)
        single = asked.astype(np.float32)
        beam, recall = wide_enough(graph, single, least, places)
        names, at = np.unique(np.concatenate((nodes, own)), return_inverse=True)
        root, pairs = np.arange(len(names)), [(own[:0], nodes[:0])]
        others, weight = np.zeros(len(own), dtype=np.int64), np.zeros(len(own), dtype=np.int64)
        for query_, found in graph.within(single, beam, least - 1e-4):
            sure = np.zeros(len(found), dtype=bool)
            for start in range(0, len(found), GATHERED // 8):
                q, f = query_[start : start + GATHERED // 8], found[start : start + GATHERED // 8]
                sure[start : start + GATHERED // 8] = (np.einsum("kd,kd->k", unit(vectors[f]), asked[q]) >= least) & (places[q] != f)
            query_, found = query_[sure], found[sure]
            others += np.bincount(query_, minlength=len(own))
            weight += np.bincount(query_, weights=copies[found], minlength=len(own)).astype(np.int64)
            root = _joined(root, at[len(nodes) :][query_], at[found])
            few = others[query_] < DENSE
            pairs.append((own[query_[few]], nodes[found[few]]))
        dense, low = np.flatnonzero(others >= DENSE), np.flatnonzero(root < np.arange(len(names)))
        a, b = (np.concatenate(column) for column in zip(*pairs))
        parts = [
            (PAIR, a, b, 0),
            (COUNT, own[dense], -1, weight[dense]),
            (EDGE, names[root[low]], names[low], 0),
        ]
        out = [pd.DataFrame({"kind": kind, "a": a, "b": b, "n": n}) for kind, a, b, n in parts]
        audit = pd.DataFrame({"kind": [AUDIT], "a": [key[2]], "b": [beam], "n": [len(own)], "few": recall[0], "many": recall[1], "planted": recall[2]})
        return pd.concat([*out, audit]).assign(shard=key[1])[FOUND]

    return query


PAIR, COUNT, EDGE, AUDIT = range(4)
FOUND = ["kind", "shard", "a", "b", "n", "few", "many", "planted"]


def links(nodes: DataFrame, least: float = COSINE) -> DataFrame:
    """What the nodes (node, vector, copies) find in the shards, of rows (kind, shard, a, b, n, few, many, planted):
    PAIR, node `a` links with `b` of the shard; COUNT, node `a` links with `n` copies of nodes of the shard and
    none is named; EDGE, a link of a spanning forest; AUDIT, block `a` of `n` queries used a beam of `b` and had
    these recalls. Vectors are distinct, finite and not zero; vectors of different lengths never link."""
    n = nodes.count()
    shards = max(MIN_SHARDS, -(-n // SHARD_VECTORS))
    blocks = max(1, -(-n // BLOCK_QUERIES))
    dealt = nodes.select("node", "vector", "copies", F.size("vector").alias("dim"), _shard("node", shards).alias("shard"))
    built = dealt.repartition(shards, "dim", "shard").groupBy("dim", "shard")
    graphs = write_table(built.applyInPandas(_build, "dim int, shard long, graph binary"), "graphs")
    asked = dealt.drop("shard", "copies").withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "node"), F.lit(blocks)))
    # Every block meets every shard: n_shards copies of the vectors, n_blocks copies of the graphs.
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<long>")))
    met = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>")))
    keys = ("dim", "shard", "block")
    parts = min(shards * blocks, MOST_TASKS)
    schema = "kind int, shard long, a long, b long, n long, few double, many double, planted double"
    sides = met.repartition(parts, *keys).groupBy(*keys), asked.repartition(parts, *keys).groupBy(*keys)
    found = write_table(sides[0].cogroup(sides[1]).applyInPandas(_met(least), schema), "found")
    # A pair is found from either side; where a side counts, it names nobody of that shard.
    pairs = found.where(f"kind = {PAIR}").select("a", "b", "shard")
    pairs = pairs.union(pairs.select("b", "a", _shard("a", shards))).distinct()
    counted = found.where(f"kind = {COUNT}").select("a", "shard")
    pairs = pairs.join(counted, ["a", "shard"], "left_anti").select(F.lit(PAIR).alias("kind"), "shard", "a", "b")
    return pairs.unionByName(found.where(f"kind <> {PAIR}"), allowMissingColumns=True)


def _shard(node: str, shards: int) -> Column:
    return F.pmod(F.xxhash64(node), F.lit(shards))


def op4_embeddings(embeddings: DataFrame, least: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    Vectors that are NULL, empty, zero or hold NULL or non-finite components link with nothing
    and are their own component. Equal vectors link with each other. A NULL vec_id links like
    any other but is no candidate for component_id; alone it has a NULL one and is kept.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    usable = F.coalesce(finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = embeddings.select("vec_id", F.when(usable, F.col("embedding")).alias("vector"))
    grouped = rows.where("vector is not null").groupBy("vector").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    # Ids of written rows stay what they are.
    nodes = write_table(grouped.withColumn("node", F.monotonically_increasing_id()), "nodes")
    found = write_table(links(nodes.select("node", "vector", "copies"), least), "links")
    named = found.where(f"kind = {PAIR}").select("a", "b").join(nodes.select(F.col("node").alias("b"), "copies"), "b")
    counted = found.where(f"kind = {COUNT}").select("a", "n")
    others = named.select("a", F.col("copies").alias("n")).union(counted).groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
    roots = components(found.where(f"kind = {EDGE}").select("a", "b"))
    placed = nodes.join(roots, "node", "left").join(others, "node", "left")
    placed = placed.select("vector", "least", F.coalesce("root", "node").alias("root"), (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    placed = write_table(placed, "placed")
    first = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    known = write_table(placed.join(first, "root").select("vector", "n_links", "component_id"), "linked")
    found = rows.join(known, "vector", "left")
    component = F.when(F.col("vector").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    out = found.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.cast("long").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
