"""Operator 8: nearest neighbours with a hierarchical k-means tree, best bin first.

The tree is fitted in numpy on a bounded sample of vectors (`SAMPLE`, drawn by hash): every node
splits its vectors into `BRANCH` clusters until `LEAF` are left. Every row of the table goes down
the tree to its leaf. A query keeps a queue of nodes ordered by the largest inner product their
vectors can be expected to have (centre, plus a share of the node's radius) and visits leaves best
first. How many leaves are visited is calibrated: for `CALIBRATION` queries, compared with all rows in blocks,
the leaves of the true neighbours are known, so the share found after v visits is known for every v
without a search. The least v that reaches `RECALL` is taken; all leaves, if need be. The target lies
above the recall of 0.9 asked for, since the queries are a sample.

Neighbouring leaves share a cell of about `BIN` rows. A query travels once to each cell that holds a leaf it
visits, with the list of these leaves, and is compared with their rows only. Larger leaves are split into
bins by hash, and more than `QUERIES` queries into blocks, so neither a vector shared by a third of all
rows nor the queries near it fill one task. Each bin keeps its best k, these are merged.

Vectors that are null, empty, zero, of another length than most, or hold null or non-finite parts
take no part; a query among them has no rows. Ties go to the smaller id. Repeated rows are rows of
their own, a query excludes the rows of its own id. Fewer than k candidates: all of them, since the
search widens until no leaf is left. Null ids take no part. Extra columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.shared import saved

K = 20
SAMPLE = 20_000
BRANCH = 8
LEAF = 32
BIN = 4_000
QUERIES = 50_000
CALIBRATION = 200
RECALL = 0.92
SPREAD = 0.35


@dataclass
class Tree:
    """Nodes by number; children of inner nodes, leaf numbers of the others."""

    centres: list[np.ndarray] = field(default_factory=list)  # per inner node: children's centres
    radii: list[np.ndarray] = field(default_factory=list)
    children: list[np.ndarray] = field(default_factory=list)  # >= 0: node, < 0: leaf -(x + 1)
    n_leaves: int = 0

    def leaf_of(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each vector: the nearest centre at every level."""
        out = np.zeros(len(rows), np.int64)
        if not self.centres:
            return out
        stack = [(0, np.arange(len(rows)))]
        while stack:
            node, ids = stack.pop()
            centres = self.centres[node]
            near = np.argmax(rows[ids] @ centres.T - 0.5 * (centres**2).sum(1), axis=1)
            for c, child in enumerate(self.children[node]):
                own = ids[near == c]
                if not len(own):
                    continue
                if child < 0:
                    out[own] = -child - 1
                else:
                    stack.append((int(child), own))
        return out

    def best_leaves(self, query: np.ndarray, most: int) -> list[int]:
        """Up to ``most`` leaves, best first."""
        if not self.centres:
            return [0]
        norm, found = float(np.linalg.norm(query)), []
        queue = [(0.0, 0)]
        while queue and len(found) < most:
            _, node = heapq.heappop(queue)
            if node < 0:
                found.append(-node - 1)
                continue
            hope = self.centres[node] @ query + SPREAD * norm * self.radii[node]
            for h, child in zip(hope.tolist(), self.children[node].tolist(), strict=True):
                heapq.heappush(queue, (-h, child))
        return found


def fit_tree(rows: np.ndarray, seed: int = 5, branch: int = BRANCH, leaf: int = LEAF) -> Tree:
    """Hierarchical k-means on the vectors of a bounded sample."""
    tree, rng = Tree(), np.random.default_rng(seed)

    def split(ids: np.ndarray) -> int:
        own = rows[ids]
        centres = own[rng.choice(len(ids), branch, replace=False)].copy()
        for _ in range(8):
            near = np.argmax(own @ centres.T - 0.5 * (centres**2).sum(1), axis=1)
            for c in range(branch):
                if (mine := near == c).any():
                    centres[c] = own[mine].mean(0)
        near = np.argmax(own @ centres.T - 0.5 * (centres**2).sum(1), axis=1)
        used = np.unique(near)
        if len(used) < 2:
            return -1
        number = len(tree.centres)
        tree.centres.append(centres[used])
        tree.radii.append(np.array([np.linalg.norm(own[near == c] - centres[c], axis=1).mean() for c in used]))
        tree.children.append(np.zeros(len(used), np.int64))
        for place, c in enumerate(used):
            inner = ids[near == c]
            child = split(inner) if len(inner) > max(leaf, branch) else -1
            if child < 0:
                child = -(tree.n_leaves + 1)
                tree.n_leaves += 1
            tree.children[number][place] = child
        return number

    if len(rows) <= max(leaf, branch) or split(np.arange(len(rows))) < 0:
        return Tree(n_leaves=1)
    return tree


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, dim).astype(np.float64)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """(vec_id, v) of the vectors that take part, and their length."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    good = F.size("v") > 0
    good &= F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).filter(good)
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim = common.d if common else 1
    return rows.filter(F.size("v") == dim), dim


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, ties to the smaller id."""
    if len(ids) > k:
        edge = np.partition(scores, len(ids) - k)[len(ids) - k]
        keep = np.flatnonzero(scores >= edge)
        return keep[np.lexsort((ids[keep], -scores[keep]))][:k]
    return np.lexsort((ids, -scores))


def cells_of(leaf_sizes: dict[int, int], n_leaves: int, size: int = BIN) -> tuple[np.ndarray, list[int]]:
    """The cell of every leaf, and the number of bins of every cell.

    Neighbouring leaves (numbered along the tree) share a cell of about ``size`` rows, so a query travels
    once to a cell instead of once to a leaf; a larger leaf is a cell of its own in several bins.
    """
    cell, held, bins = np.zeros(n_leaves, np.int64), 0, [1]
    for leaf in range(n_leaves):
        rows = leaf_sizes.get(leaf, 0)
        if held and held + rows > size:
            bins.append(1)
            held = 0
        cell[leaf] = len(bins) - 1
        held += rows
        bins[-1] = max(1, -(-held // size))
    return cell, bins


def _found(bins: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): the best k of each cell's bin in the leaves a query asks for."""

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(left) and len(right):
            left = left.sort_values(["leaf", "vec_id"], kind="stable")
            own, leaves = left["vec_id"].to_numpy(), left["leaf"].to_numpy()
            rows = np.stack(left["v"].to_list()).astype(np.float64)
            for query, vector, wanted in zip(right["query_id"].to_numpy(), right["q"], right["leaves"], strict=True):
                low, high = np.searchsorted(leaves, wanted, "left"), np.searchsorted(leaves, wanted, "right")
                at = np.concatenate([np.arange(a, b) for a, b in zip(low, high)]) if len(wanted) else np.zeros(0, int)
                at = at[own[at] != query]
                # the same sum for a pair whatever rows stand around it
                score = np.einsum("d,rd->r", np.asarray(vector, np.float64), rows[at])
                best = _best(own[at], score, k)
                out.append((np.full(len(best), query), own[at][best], score[best]))
        columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [[], [], []]
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), columns)))

    by = ["cell", "bin", "block"]
    return bins.groupBy(*by).cogroup(asked.groupBy(*by)).applyInPandas(meet, "query_id long, vec_id long, score double")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )


def _brute(rows: DataFrame, ids: np.ndarray, queries: np.ndarray, k: int, dim: int) -> DataFrame:
    """Exact neighbours of a bounded set of queries: each partition's best, merged."""
    sent = rows.sparkSession.sparkContext.broadcast((ids, queries))  # CALIBRATION vectors

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, vectors = sent.value
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                own = batch.column(0).to_numpy()
                scores = np.einsum("qd,rd->qr", vectors, _matrix(batch.column(1), dim))
                out = []
                for query, line in zip(names, scores, strict=True):
                    other = np.flatnonzero(own != query)
                    best = other[_best(own[other], line[other], k)]
                    out.append((np.full(len(best), query), own[best], line[best]))
                yield pa.record_batch([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["query_id", "vec_id", "score"])

    return _ranked(rows.select("vec_id", "v").mapInArrow(scan, "query_id long, vec_id long, score double"), k)


def nearest(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20, k: int = K, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): for rows whose id is divisible by ``every``, k neighbours each."""
    spark = vectors.sparkSession
    rows, dim = usable(vectors, id_col, vector_col)
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toArrow()
    sample = _matrix(drawn.column("v").combine_chunks(), dim) if drawn.num_rows else np.zeros((0, dim))
    tree = fit_tree(sample)
    shared = spark.sparkContext.broadcast(tree)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = shared.value.leaf_of(_matrix(batch.column(1), dim)) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.record_batch([*batch.columns, pa.array(leaf)], names=["vec_id", "v", "leaf"])

    kind = vectors.schema[vector_col].dataType.simpleString()
    kind = kind if kind == "array<float>" else "array<double>"  # floats travel as floats and are exact as doubles
    placed = saved(rows.mapInArrow(place, "vec_id long, v array<double>, leaf long").withColumn("v", F.col("v").cast(kind)), "placed")
    # one number per leaf, which the sample bounds
    leaf_sizes = {r.leaf: r.n for r in placed.groupBy("leaf").agg(F.count("*").alias("n")).collect()}
    cell, cell_bins = cells_of(leaf_sizes, tree.n_leaves)
    dealt = spark.sparkContext.broadcast((cell, np.array(cell_bins)))
    queries = placed.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    blocks = max(1, -(-queries.count() // QUERIES))

    def at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, counts = dealt.value
        for batch in batches:
            own = cells[batch.column(2).to_numpy()]
            yield pa.record_batch([*batch.columns, pa.array(own), pa.array(counts[own])], names=["vec_id", "v", "leaf", "cell", "bins"])

    homes = placed.mapInArrow(at_home, f"vec_id long, v {kind}, leaf long, cell long, bins long")
    homes = homes.select("cell", F.pmod(F.xxhash64("vec_id"), "bins").cast("int").alias("bin"), "leaf", "vec_id", "v")
    homes = homes.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def search(asked: DataFrame, visits: int) -> DataFrame:
        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cells, counts = dealt.value
            for batch in batches:
                pick, place, wanted = [], [], []
                for n, q in enumerate(_matrix(batch.column(1), dim) if batch.num_rows else ()):
                    leaves = np.sort(np.array(shared.value.best_leaves(q, visits), np.int64))
                    for c in np.unique(cells[leaves]):
                        pick.append(n), place.append(c), wanted.append(leaves[cells[leaves] == c])
                some = batch.take(pa.array(pick, pa.int64()))
                place = np.array(place, np.int64)
                yield pa.record_batch(
                    [*some.columns, pa.array(place), pa.array(counts[place]), pa.array(wanted, pa.list_(pa.int64()))],
                    names=["query_id", "q", "cell", "bins", "leaves"],
                )

        sent = asked.mapInArrow(route, f"query_id long, q {kind}, cell long, bins long, leaves array<long>")
        sent = sent.withColumn("bin", F.explode(F.sequence(F.lit(0), F.col("bins").cast("int") - 1)))
        sent = sent.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
        return _ranked(_found(homes, sent.select("cell", "bin", "block", "query_id", "q", "leaves"), k), k)

    # calibration searches nothing: a true neighbour is found as soon as its leaf is visited
    trial = saved(queries.orderBy(F.xxhash64("query_id", F.lit("trial")), "query_id").limit(CALIBRATION), "trial")
    got = trial.toArrow()
    visits = tree.n_leaves
    if got.num_rows:
        asked = _matrix(got.column(1).combine_chunks(), dim)
        exact = _brute(rows, got.column(0).to_numpy(), asked, k, dim)
        homes_of = exact.join(placed.select("vec_id", "leaf"), "vec_id").select("query_id", "leaf").toArrow()  # CALIBRATION * k rows
        order = {q: np.argsort(tree.best_leaves(v, tree.n_leaves)) for q, v in zip(got.column(0).to_pylist(), asked, strict=True)}
        turn = sorted(int(order[q][leaf]) for q, leaf in zip(homes_of.column(0).to_pylist(), homes_of.column(1).to_pylist(), strict=True))
        if turn:
            visits = turn[min(len(turn), math.ceil(recall * len(turn))) - 1] + 1
    # small tables: as long as a query can find less than k, every leaf is visited
    wide = min(visits, tree.n_leaves) if placed.limit(4 * k + 1).count() > 4 * k else tree.n_leaves
    first = saved(search(queries, wide), "found")
    short = first.groupBy("query_id").agg(F.count("*").alias("n")).filter(F.col("n") < k).select("query_id")
    empty = queries.join(first.select("query_id").distinct(), "query_id", "left_anti")
    if wide < tree.n_leaves:
        again = saved(queries.join(short, "query_id", "left_semi").union(empty), "short")
        if again.limit(1).count():
            rest = search(again, tree.n_leaves)
            first = first.join(again.select("query_id"), "query_id", "left_anti").unionByName(rest)
    return first.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
