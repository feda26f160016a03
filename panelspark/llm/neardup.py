"""Operator 3: MinHash near-duplicates by a multi-index Hamming join.

A document is the set of its distinct word shingles (A-Z lower-cased; fewer words than a shingle:
the whole sequence is one). Documents with equal sets form a class, and classes are compared.

Each class has a signature of `HASHES` minima, 16 bits each. Two signatures are near when at most
T minima differ; T lies 3.6 standard deviations above the number expected at the similarity asked
for. The signature is cut into floor(T / 2) + 1 chunks: by pigeonhole, two near signatures have a
chunk with at most one difference. Every way to leave one minimum out of every chunk is a key, so
near classes always share a key. Candidates are confirmed on the full sets.

A key that many classes share is not expanded into all pairs. All its classes are measured against
one of them, then against the class nearest to that one, which in a group of edited copies is the
original or close to it; what is linked to such a centre c is one component. A class o that is not
linked to its centre can still be linked to other classes m of the key. Let o differ from c by the
set D(o), made of added and removed shingles, and let t be the largest difference at which o and m
are linked. Since |D(o) - D(m)| + |D(m) - D(o)| <= t and the shared removed shingles are at most all
that m removed, o and m share at least (|D(o)| - t + |m| - |c|) / 2 added shingles; with the sides
exchanged, at least (|D(o)| - t + |c| - |m|) / 2 removed ones. One of the two is positive because o
is not linked to c. So each pair has a side on which it must share that many elements, and one of
them is among the rarest of o on that side but for that many: these are joined, the pairs found are
confirmed. Edited copies share few added shingles, so a large group makes few pairs, and no link
between components is lost. Pairs inside a component cannot change the result and are skipped.

Null and empty texts, and texts of white space, have an empty set and are linked with nothing.
Repeated rows form one class; rows that share an id but not a text are different documents. A null
id counts as larger than any other; a group of nulls only has a null id and keeps its rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.components import components
from panelspark.llm.shared import batch_word_hashes, fresh_name, mix, saved

HASHES = 48
SALTS = 16

_rng = np.random.default_rng(7141)
_XOR = _rng.integers(1, 2**63, HASHES, dtype=np.uint64)
_MUL = _rng.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def allowed_distance(similarity: float, hashes: int = HASHES) -> int:
    miss = 1 - similarity
    return math.ceil(hashes * miss + 3.6 * math.sqrt(hashes * miss * similarity))


def chunks(similarity: float, hashes: int = HASHES) -> list[range]:
    """Places of each chunk; with these, T differences leave one chunk with at most one."""
    n = allowed_distance(similarity, hashes) // 2 + 1
    edges = [hashes * i // n for i in range(n + 1)]
    return [range(a, b) for a, b in zip(edges, edges[1:], strict=False)]


def _shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the distinct shingles of a document's word hashes."""
    if not len(words):
        return words
    k = min(k, len(words))
    out = np.zeros(len(words) - k + 1, np.uint64)
    for i in range(k):
        out = mix(out + words[i : len(words) - k + 1 + i] + np.uint64(k))
    return np.unique(out)


def signature(sets: np.ndarray) -> np.ndarray:
    """The 16-bit minima of a non-empty set of hashes."""
    least = np.empty(HASHES, np.uint64)
    for i in range(HASHES):
        least[i] = np.min((sets ^ _XOR[i]) * _MUL[i])
    return (mix(least) & np.uint64(0xFFFF)).astype(np.uint64)


def _keys(sig: np.ndarray, cut: list[range]) -> np.ndarray:
    """One 64-bit key per place left out."""
    coded = mix(sig + (np.arange(len(sig), dtype=np.uint64) << np.uint64(16)) + np.uint64(1))
    out = np.empty(len(sig), np.uint64)
    for number, places in enumerate(cut):
        part = coded[places.start : places.stop]
        out[places.start : places.stop] = part.sum(dtype=np.uint64) - part + np.uint64(number)
        out[places.start : places.stop] += mix(np.arange(places.start, places.stop, dtype=np.uint64) + np.uint64(977))
    return mix(out)


def _class_of(found: np.ndarray) -> bytes:
    """128 bits that name a set, whatever its order."""
    return mix(np.array([found.sum(dtype=np.uint64), mix(found ^ np.uint64(0x5DEECE66D)).sum(dtype=np.uint64)])).tobytes()


def described(docs: DataFrame, k: int, similarity: float) -> DataFrame:
    """(doc_id, twin, n, node, keys) of (doc_id, text, twin): set size, class and chunk keys; an empty set has no class."""
    cut = chunks(similarity)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                hashes, counts = batch_word_hashes(batch.column(1).to_pylist())
                ends, sizes, nodes, keys = np.cumsum(counts), [], [], []
                for end, count in zip(ends, counts, strict=True):
                    found = _shingles(hashes[end - count : end], k)
                    sizes.append(len(found))
                    if len(found):
                        nodes.append(_class_of(found))
                        keys.append(_keys(signature(found), cut).view(np.int64))
                    else:
                        nodes.append(None)
                        keys.append(None)
                yield pa.record_batch(
                    [batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                    names=["doc_id", "twin", "n", "node", "keys"],
                )

    return docs.mapInArrow(describe, "doc_id long, twin long, n long, node binary, keys array<long>")


def _shingle_sets(texts: DataFrame, k: int) -> DataFrame:
    """(node, shingles) for (node, text); a text of another class, of a row that shares an id, goes."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                hashes, counts = batch_word_hashes(batch.column(1).to_pylist())
                sets = [_shingles(hashes[e - c : e], k) for e, c in zip(np.cumsum(counts), counts, strict=True)]
                own = [(node, found.view(np.int64)) for node, found in zip(batch.column(0).to_pylist(), sets, strict=True) if len(found) and node == _class_of(found)]
                yield pa.record_batch(
                    [pa.array([x for x, _ in own], pa.binary()), pa.array([x for _, x in own], pa.list_(pa.int64()))],
                    names=["node", "shingles"],
                )

    return texts.mapInArrow(spread, "node binary, shingles array<long>")


def _allowed(n: Column, m: Column, percent: int) -> Column:
    """The largest symmetric difference at which sets of n and m elements are linked."""
    return F.floor((100 - percent) * (n + m) / (100 + percent))


def _size_fits(n: Column, m: Column, percent: int) -> Column:
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def near_components(docs: DataFrame, k: int = 3, percent: int = 85) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, twin, n, node) of ``docs`` (doc_id, text, twin), and (node, root) of the linked classes."""
    told = saved(described(docs, k, percent / 100), "signatures")
    rows = told.select("doc_id", "twin", "n", "node")
    classes = told.filter("node IS NOT NULL").groupBy("node").agg(
        F.first("n").alias("n"), F.first("keys").alias("keys"),
        F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "twin")).alias("at"),
    )
    spots = classes.select("node", "n", "at", F.explode("keys").alias("key"))
    shared = spots.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select("key")
    members = saved(spots.join(shared, "key"), "members")
    # texts of one document per class that shares a key
    lead = members.select("node", "at").distinct()
    lead = lead.select("node", F.col("at.doc_id").alias("at_id"), F.col("at.twin").alias("at_twin"))
    # by id and text: rows without id meet only their own class
    texts = docs.join(lead, docs["doc_id"].eqNullSafe(F.col("at_id")) & (docs["twin"] == F.col("at_twin"))).select("node", "text")
    sets = saved(_shingle_sets(texts, k), "sets")

    def with_sets(pairs: DataFrame) -> DataFrame:
        """Pairs (c, node, ...) with both sets, a of c and b of node."""
        left = sets.select(F.col("node").alias("c"), F.col("shingles").alias("a"))
        return pairs.join(left, "c").join(sets.withColumnRenamed("shingles", "b"), "node")

    def measured(pairs: DataFrame) -> DataFrame:
        """(c, node, d, linked): the symmetric difference of distinct pairs."""
        size, common = F.size("a") + F.size("b"), F.size(F.array_intersect("a", "b"))
        d = with_sets(pairs).select("c", "node", (size - 2 * common).alias("d"), size.alias("s"))
        return saved(d.select("c", "node", "d", ((100 - percent) * F.col("s") >= (100 + percent) * F.col("d")).alias("linked")), "measured")

    def linked(pairs: DataFrame) -> DataFrame:
        return pairs.filter("linked").select(F.col("c").alias("u"), F.col("node").alias("v"))

    # all classes of a key against its least one
    first = members.groupBy("key").agg(F.min("node").alias("c"), F.count("*").alias("c_rows"))
    starred = saved(members.join(first, "key").filter("node != c"), "starred")
    near = measured(starred.select("c", "node").distinct())
    # then against the one nearest to that
    larger = starred.filter("c_rows > 2").join(near.select("c", "node", "d"), ["c", "node"])
    centres = larger.groupBy("key").agg(F.min(F.struct("d", "node", "n")).alias("m")).select("key", F.col("m.node").alias("c2"), F.col("m.n").alias("c_n"))
    around = saved(members.select("key", "node", "n").join(centres, "key").filter("node != c2"), "around")
    second = measured(around.select(F.col("c2").alias("c"), "node").distinct())
    links = linked(near).union(linked(second))
    roots = saved(components(links), "roots")
    # classes outside their centre's component
    named = around.select(F.col("c2").alias("c"), "c_n", "node", "n").distinct().join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = named.join(roots.select(F.col("node").alias("c"), F.col("root").alias("c_root")), "c", "left")
    named = saved(named.withColumn("outside", F.col("root") != F.coalesce("c_root", "c")), "named")
    some = named.filter("outside").select("c").distinct()
    kept = ["c", "c_n", "node", "n", "root", "outside"]
    both = with_sets(named.join(some, "c", "left_semi").select(*kept))
    both = both.select(*kept, F.array_except("b", "a").alias("plus"), F.array_except("a", "b").alias("minus"))
    both = both.withColumn("d", F.size("plus") + F.size("minus"))
    sides = F.array(F.struct(F.lit(True).alias("added"), F.col("plus").alias("xs")), F.struct(F.lit(False).alias("added"), F.col("minus").alias("xs")))
    edits = both.select(*kept, "d", F.explode(sides).alias("s")).select(*kept, "d", "s.added", F.size("s.xs").alias("on_side"), F.explode("s.xs").alias("x"))
    edits = saved(edits, "edits")
    common = edits.groupBy("c", "x").agg(F.count("*").alias("often"), F.bool_or("outside").alias("asked")).filter("often > 1 AND asked")
    rarest = Window.partitionBy("c", "node", "added").orderBy("often", "x")
    # elements that nobody shares come first in the order and find nothing
    probes = edits.filter("outside").join(common.select("c", "x", "often"), ["c", "x"], "left").withColumn("often", F.coalesce("often", F.lit(1)))
    probes = probes.withColumn("r", F.row_number().over(rarest)).filter("often > 1")
    probes = probes.select(
        "c", "x", "c_n", "added", "on_side", "r", F.col("d").alias("o_d"), F.col("node").alias("o"), F.col("n").alias("o_n"), F.col("root").alias("o_root")
    )
    gap = F.col("o_d") - _allowed(F.col("n"), F.col("o_n"), percent)
    longer = F.col("n") - F.col("c_n")
    share = F.ceil(F.when(F.col("added"), gap + longer).otherwise(gap - longer) / 2)
    its_side = F.col("added") == (gap + longer > 0)
    pairs = probes.join(edits.select("c", "x", "node", "n", "root"), ["c", "x"]).filter(
        (F.col("root") != F.col("o_root")) & _size_fits(F.col("n"), F.col("o_n"), percent) & its_side & (F.col("r") <= F.col("on_side") - share + 1)
    )
    pairs = pairs.select(F.least("o", "node").alias("c"), F.greatest("o", "node").alias("node")).distinct()
    roots = saved(components(links.union(linked(measured(pairs)))), "roots")
    return rows, roots


def _decided(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(doc_id, twin, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text)."""
    rows, roots = near_components(docs.select("doc_id", "text", F.xxhash64("text").alias("twin")), k, percent)
    # groups are decided on classes, one row each; a group of many classes meets its row in SALTS parts
    classes = rows.filter("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("c"))
    rooted = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    groups = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("c").alias("c")).filter("c > 1")
    parts = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    decided = rooted.select("node", "root", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int").alias("salt")).join(parts, ["root", "salt"])
    joined = rows.join(decided.select("node", "component_id", "c"), "node", "left")
    group = F.when(F.col("c").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    kept = F.col("doc_id").eqNullSafe(group).alias("kept")
    return joined.select("doc_id", "twin", F.col("n").alias("n_shingles"), group.alias("component_id"), kept)


def near_duplicates(docs: DataFrame, k: int = 3, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``."""
    return _decided(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), k, percent).drop("twin")


def near_duplicate_stage(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The kept rows of ``docs``, with their own columns; of rows that share id and text one stays.

    A row with neither id nor text goes.
    """
    docs = docs.filter(docs["doc_id"].isNotNull() | docs["text"].isNotNull())
    own, twin, key = (fresh_name(docs, n) for n in ("kept_id", "kept_twin", "text_twin"))
    kept = _decided(docs.select("doc_id", "text"), k, percent).filter("kept").select(F.col("doc_id").alias(own), F.col("twin").alias(twin)).distinct()
    rows = docs.withColumn(key, F.xxhash64("text"))
    same = rows["doc_id"].eqNullSafe(F.col(own)) & (rows[key] == F.col(twin))
    return rows.join(kept, same, "left_semi").dropDuplicates(["doc_id", key]).drop(key)
