"""Operator 13: the prefix trie of conversations, by union-find over sorted neighbours.

A conversation becomes a path of 16-byte turn hashes. Paths are sorted and dealt to range
partitions; the members of a trie node are then a stretch of the order, and two neighbours share
as many turns as their longest common prefix (LCP). In each partition the edges between neighbours
are taken by descending LCP and their ends united: a union at depth d makes a branching node at
depth d, or joins one that is there already. What is left is the compressed trie of the partition;
turns between two branching nodes have the members of the lower one.

Only nodes that hold a partition's first or last conversation, no deeper than the LCP across
that border, can go on in the neighbouring partition. They are contracted to one row each: counts,
sums and the least member, all of which add up over partitions because each node is counted where
its first member lies. Rows of equal path are merged by a grouping with map-side sums; all other
nodes are finished where they are. Children of such nodes find them by (partition, node), so that a
first turn shared by a third of all conversations, or the root, is no hot key.

Ordering: turns by turn number (null first), then role and MD5 of the text where numbers tie; paths by hash,
then conversation id. Null roles and texts are empty ones; repeated rows are turns of their own; rows
without conversation id belong to none and are left out. Extra columns are ignored. An empty table
gives an empty one, without root. A path and its word counts are one row (24 bytes a turn), so memory
is bounded by the longest conversation and by ``TURNS`` turns per partition, not by the
number of members of a node. The members that end at a node are hashed in order, as text blocks of
``BLOCK`` ids if they lie in several partitions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.shared import WORD, saved
from panelspark.session import cut

HASH = 16
TURNS = 250_000
BLOCK = 512
BATCH = 20_000
NOTHING = hashlib.sha256(b"").hexdigest()
SUMS = ("n_convs", "n_children", "n_leaves", "saved_tokens")
RESULT = ("conv_id", "depth", "parent_conv_id", *SUMS, "ends_sha256")


# ---- paths ----------------------------------------------------------------------------------


def turn_paths(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): per conversation its ordered (hash, words) turns; texts are not shuffled."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    rows = turns.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(
            F.col("turn").isNotNull().alias("numbered"), F.col("turn").alias("turn"), role.alias("role"),
            F.md5(text).alias("tie"), F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("hash"),
            F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
        ).alias("t"),
    )
    lists = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return lists.select("conv_id", F.transform("t", lambda t: F.struct(t["hash"].alias("hash"), t["words"].alias("words"))).alias("turns"))


def rebuilt(paths: DataFrame, family: int = 20, shared: int = 4) -> DataFrame:
    """Conversation c begins with the first h turns of c - c % family, h = crc32(c) % shared, and goes on with its own."""
    heads = paths.filter(F.col("conv_id") % family == 0).select(
        F.col("conv_id").alias("lead"), F.slice("turns", 1, shared - 1).alias("head")
    )
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % shared).cast("int")
    own = paths.withColumn("h", h).withColumn("lead", F.col("conv_id") - F.col("conv_id") % family)
    none = F.array().cast(paths.schema["turns"].dataType)
    head = F.when(F.col("h") > 0, F.slice(F.coalesce("head", none), F.lit(1), F.greatest("h", F.lit(1)))).otherwise(none)
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))
    return own.join(heads, "lead", "left").select("conv_id", F.concat(head, rest).alias("turns"))


def sorted_paths(paths: DataFrame, per_part: int = TURNS) -> DataFrame:
    """(part, path, words, conv_id) in range partitions, written down so that every reader sees the same ones."""
    path = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["hash"])), ""))
    rows = saved(paths.select(path.alias("path"), F.transform("turns", lambda t: t["words"]).alias("words"), "conv_id"), "paths")
    turns = rows.agg(F.sum(F.size("words") + 1)).first()[0] or 0
    parts = max(1, -(-turns // per_part))
    dealt = rows.repartitionByRange(parts, "path", "conv_id").sortWithinPartitions("path", "conv_id")
    return cut(dealt).withColumn("part", F.spark_partition_id())


def lcp(a: bytes, b: bytes) -> int:
    """Turns that two paths share from the start."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // HASH
    if n <= 8 * HASH:
        k = 0
        while a[k : k + HASH] == b[k : k + HASH]:
            k += HASH
        return k // HASH
    x, y = (np.frombuffer(v, np.uint64, n // 8).reshape(-1, 2) for v in (a, b))
    return int(np.argmax((x != y).any(axis=1)))


def borders(ordered: DataFrame) -> dict[int, tuple[int, int]]:
    """LCP of every partition with rows across its lower and upper border; -1 at the ends.

    Two numbers per partition reach the driver; the paths compared are two per partition.
    """

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = last = None
        for batch in batches:
            if len(batch):
                first = batch.iloc[0] if first is None else first
                last = batch.iloc[-1]
        if first is not None:
            yield pd.DataFrame([(first["part"], first["path"], last["path"])], columns=["part", "first", "last"])

    table = cut(ordered.select("part", "path").mapInPandas(ends, "part int, first binary, last binary"))
    parts = sorted(r.part for r in table.select("part").collect())
    follows = table.sparkSession.createDataFrame(list(zip(parts, parts[1:])), "part int, after int")
    after = table.select(F.col("part").alias("after"), "first")
    common = F.udf(lambda a, b: lcp(bytes(a), bytes(b)), "long")
    across = follows.join(table.select("part", "last"), "part").join(after, "after").select("part", "after", common("last", "first").alias("n"))
    out = {p: [-1, -1] for p in parts}
    for row in across.collect():
        out[row.part][1] = out[row.after][0] = row.n
    return {p: (a, b) for p, (a, b) in out.items()}


# ---- one partition --------------------------------------------------------------------------


def compressed(lengths: list[int], common: list[int]) -> tuple[list[int], list[int], list[int], list[int]]:
    """(depth, first, last, parent) of the branching and end nodes of sorted paths.

    ``common[i]`` is the LCP of paths i and i + 1. Edges are united by descending LCP; the node of the
    whole (depth 0) has parent -1, a node that was joined to another one has parent -2.
    """
    n = len(lengths)
    depth, first, last, parent = list(lengths), list(range(n)), list(range(n)), [-1] * n
    up, top = list(range(n)), list(range(n))

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    joined: dict[int, int] = {}
    for edge in sorted(range(n - 1), key=lambda i: -common[i]):
        d, a, b = common[edge], find(edge), find(edge + 1)
        s, t = top[a], top[b]
        if depth[s] == d and depth[t] == d:
            parent[t], joined[t] = -2, s
            node = s
        elif depth[s] == d:
            parent[t] = node = s
        elif depth[t] == d:
            parent[s] = node = t
        else:
            node = len(depth)
            depth.append(d), first.append(0), last.append(0), parent.append(-1)
            parent[s] = parent[t] = node
        low, high = first[s], last[t]
        first[node], last[node] = low, high
        up[b] = a
        top[a] = node
    whole = top[find(0)]
    if depth[whole] > 0:
        depth.append(0), first.append(0), last.append(n - 1), parent.append(-1)
        parent[whole] = len(depth) - 1

    def where(x: int) -> int:
        while x in joined:
            x = joined[x]
        return x

    return depth, first, last, [p if p < 0 else where(p) for p in parent]


class Stretch:
    """The sorted conversations of one partition and what any stretch of them adds up to."""

    def __init__(self, paths: list[bytes], words: list[np.ndarray], ids: list[int], border: tuple[int, int]) -> None:
        self.paths, self.ids, (self.below, self.above) = paths, ids, border
        n = len(paths)
        self.lengths = [len(p) // HASH for p in paths]
        self.common = [lcp(paths[i], paths[i + 1]) for i in range(n - 1)]
        self.upto = [np.concatenate([[0], np.cumsum(w, dtype=np.int64)]) for w in words]
        prev = [self.below, *self.common]
        after = [*self.common, self.above]
        total = np.array([u[-1] for u in self.upto], np.int64)
        new = total - np.array([u[max(p, 0)] for u, p in zip(self.upto, prev)], np.int64)
        ends = np.array([a < m for a, m in zip(after, self.lengths)], np.int64)
        self.all_words, self.new_words, self.leaves = (np.concatenate([[0], np.cumsum(x)]) for x in (total, new, ends))

    def nodes(self) -> Iterator[tuple]:
        """(conv_id, depth, parent id, n_convs, n_children, n_leaves, saved, ends, side, parent's side).

        Those of one compressed edge together, the deepest first. ``ends`` is a range of rows. A side is
        None for a node that lies in this partition alone, else the row whose path begins with it:
        the first or the last one.
        """
        depth, first, last, parent = compressed(self.lengths, self.common)
        least = self._least(depth, first, last, parent)
        children = [0] * len(depth)
        for v, p in enumerate(parent):
            if p >= 0 and (first[v] > 0 or self.below <= depth[p]):
                children[p] += 1
        n = len(self.paths)
        for v, p in enumerate(parent):
            if p == -2:
                continue
            low, high, d = first[v], last[v], depth[v]
            floor = depth[p] if p >= 0 else -1
            count, upto = high - low + 1, self.upto[low]
            used = int(self.all_words[high + 1] - self.all_words[low])
            fresh = int(self.new_words[high + 1] - self.new_words[low + 1])
            leaves = int(self.leaves[high + 1] - self.leaves[low])
            k = low
            while k <= high and self.lengths[k] == d:
                k += 1
            for at in range(d, floor, -1):
                before = int(upto[max(at - 1, 0)])
                started = int(upto[-1] - upto[max(at - 1, self.below if low == 0 else 0, 0)])
                more = children[v] if at == d else int(low > 0 or self.below <= at)
                up = least[v] if at > floor + 1 else (least[p] if p >= 0 else None)
                over = v if at > floor + 1 else p
                yield (
                    least[v], at, up, count, more, leaves, (used - count * before) - (fresh + started),
                    (low, k) if at == d and k > low else None, self._side(at, low, high),
                    self._side(at - 1, first[over], last[over]) if at else None,
                )

    def _side(self, at: int, low: int, high: int) -> int | None:
        if low == 0 and at <= self.below:
            return 0
        return high if high == len(self.paths) - 1 and at <= self.above else None

    def _least(self, depth: list[int], first: list[int], last: list[int], parent: list[int]) -> list[int]:
        """Least conversation id of every node: a node's own ends and its children, the deepest first."""
        out = [self.ids[f] for f in first]
        for v, (d, low, high) in enumerate(zip(depth, first, last)):
            k = low
            while k <= high and self.lengths[k] == d:
                out[v] = min(out[v], self.ids[k])
                k += 1
        for v in sorted((v for v, p in enumerate(parent) if p >= 0), key=lambda v: -depth[v]):
            out[parent[v]] = min(out[parent[v]], out[v])
        return out

    def keys(self, side: int) -> list[bytes]:
        """Digests of the first 0, 1, 2, ... turns of the path in row ``side``, down to the LCP across a border."""
        out, made, path = [], hashlib.md5(), self.paths[side]
        for d in range(min(max(self.below, self.above), self.lengths[side]) + 1):
            out.append(made.copy().digest() + d.to_bytes(4, "big"))
            made.update(path[d * HASH : (d + 1) * HASH])
        return out


NODE = (
    "part int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
    "ends_sha256 string, node binary, parent binary, ends array<string>"
)
NODE_NAMES = [x.split()[0] for x in NODE.split(", ")]


def _partition_nodes(border: dict[int, tuple[int, int]]):
    """Rows of ``NODE`` for one partition: ``node`` is set for open nodes, ``parent`` where the parent is open."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        paths, words, ids, part = [], [], [], None
        for batch in batches:
            if len(batch):
                part = int(batch["part"].iloc[0])
                paths += [bytes(p) for p in batch["path"]]
                words += list(batch["words"])
                ids += batch["conv_id"].tolist()
        if not ids:
            return
        here = Stretch(paths, words, ids, border[part])
        keys = {side: here.keys(side) for side in {0, len(paths) - 1}}

        rows: list[tuple] = []
        for conv, at, up, count, more, leaves, saving, ends, side, up_side in here.nodes():
            blocks, digest = None, None
            if ends and side is not None:
                blocks = [",".join(map(str, ids[i : min(i + BLOCK, ends[1])])) for i in range(ends[0], ends[1], BLOCK)]
            elif side is None:
                digest = hashlib.sha256(",".join(map(str, ids[ends[0] : ends[1]])).encode()).hexdigest() if ends else NOTHING
            rows.append((
                part, conv, at, up if up_side is None else None, count, more, leaves, saving, digest,
                None if side is None else keys[side][at], None if up_side is None else keys[up_side][at - 1], blocks,
            ))
            if len(rows) >= BATCH:
                yield _frame(rows)
                rows = []
        if rows:
            yield _frame(rows)

    return run


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=NODE_NAMES)
    out["parent_conv_id"] = out["parent_conv_id"].astype("Int64")
    return out


# ---- across partitions ----------------------------------------------------------------------


def _digests(pieces: DataFrame) -> DataFrame:
    """(node, ends_sha256) from ordered blocks of ids: one pass that holds one block and one hash state."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for batch in batches:
            out = []
            for node, ids in zip(batch["node"], batch["ids"]):
                if node != now:
                    if now is not None:
                        out.append((now, state.hexdigest()))
                    now, state = node, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            yield pd.DataFrame(out, columns=["node", "ends_sha256"])
        if now is not None:
            yield pd.DataFrame([(now, state.hexdigest())], columns=["node", "ends_sha256"])

    dealt = pieces.repartition("node").sortWithinPartitions("node", "part", "at")
    return dealt.mapInPandas(run, "node binary, ends_sha256 string")


def trie_nodes(paths: DataFrame, per_part: int = TURNS) -> DataFrame:
    """The trie of (conv_id, turns) rows: one row per node, columns ``RESULT``."""
    ordered = sorted_paths(paths, per_part)
    rows = saved(ordered.mapInPandas(_partition_nodes(borders(ordered)), NODE), "nodes")
    open_rows = rows.filter("node IS NOT NULL")
    merged = open_rows.groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("parent").alias("parent"),
        *[F.sum(c).alias(c) for c in SUMS],
    )
    pieces = open_rows.select("node", "part", F.posexplode("ends").alias("at", "ids"))
    merged = merged.join(_digests(pieces), "node", "left")
    merged = saved(merged.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOTHING))), "open")
    above = merged.select(F.col("node").alias("parent"), F.col("conv_id").alias("above"))
    whole = merged.join(above, "parent", "left").withColumn("parent_conv_id", F.col("above"))
    # finished nodes under open ones look their parent up among the open nodes of their own partition
    seen = open_rows.select("part", F.col("node").alias("parent")).distinct().join(above, "parent")
    under = rows.filter("node IS NULL AND parent IS NOT NULL").drop("parent_conv_id").join(seen, ["part", "parent"])
    under = under.withColumn("parent_conv_id", F.col("above"))
    done = rows.filter("node IS NULL AND parent IS NULL")
    return done.select(*RESULT).union(under.select(*RESULT)).union(whole.select(*RESULT))


def conversation_trie(turns: DataFrame, family: int = 20, shared: int = 4, per_part: int = TURNS) -> DataFrame:
    """Rebuild the conversations of (conv_id, turn, role, text) rows and return the nodes of their prefix trie."""
    return trie_nodes(rebuilt(turn_paths(turns), family, shared), per_part)
