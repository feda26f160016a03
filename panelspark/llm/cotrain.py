"""Operator 1: quality classifier by co-training.

Two views of a document: its text (byte classes, their successions, repetition, hashed words) and
its metadata (source, language, length as recorded). Each view has a logistic classifier, trained
in numpy on a bounded sample of labelled rows (`LABELLED`, drawn by hash). In each of `ROUNDS` rounds
every classifier names the rows it is surest of among all rows without a label, `SURE` per class at most and
only beyond `LEVEL`, equal rows once; the other classifier learns from them. A fold
of the labelled rows is held back: it calibrates each view (Platt) and weighs the calibrated views
together, so a view that knows nothing counts for nothing. Every document of the table is scored.

The threshold is the least score of the held-back good documents but for `REFUSE` of them, and not
above one half, so that clean documents are kept.

Null texts are empty, null metadata is a value of its own, and both are scored like others. Without
both classes among the labels every score is the share of good labels (or 0.5 without labels).
Labels that contradict each other for one id are averaged and rounded up. Repeated rows get equal
scores. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.shared import batch_word_hashes, saved

LABELLED = 4_000
BROADCAST_IDS = 1_000_000
ROUNDS = 4
SURE = 150
LEVEL = 0.95
REFUSE = 0.002
BUCKETS = 1 << 10
META = 128

# byte classes: other, lower, upper, digit, space, line feed, sentence mark, symbol, beyond ASCII
_CLASS = np.zeros(256, np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[[32, 9, 13]], _CLASS[10] = 1, 2, 3, 4, 5
_CLASS[[ord(c) for c in ".,;:!?'\"-()"]] = 6
_CLASS[[ord(c) for c in "#$%&*+/<=>@[]\\^_`{|}~"]] = 7
_CLASS[128:] = 8
N_CLASS = 9
WIDTH = N_CLASS + N_CLASS**2 + 6 + BUCKETS


def text_features(texts: list[str | None]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Dense features of each text, and its hashed words as (buckets, weights)."""
    hashes, counts = batch_word_hashes(texts)
    ends = np.cumsum(counts)
    dense, sparse = np.zeros((len(texts), WIDTH - BUCKETS)), []
    for i, text in enumerate(texts):
        data = (text or "").encode("utf-8", "surrogatepass")
        raw = _CLASS[np.frombuffer(data, np.uint8)]
        own = hashes[ends[i] - counts[i] : ends[i]]
        n, w = max(len(raw), 1), max(len(own), 1)
        dense[i, :N_CLASS] = np.bincount(raw, minlength=N_CLASS) / n
        pairs = raw[:-1] * np.uint8(N_CLASS) + raw[1:]
        dense[i, N_CLASS : N_CLASS + N_CLASS**2] = np.sqrt(np.bincount(pairs, minlength=N_CLASS**2) / n)
        words, times = np.unique(own, return_counts=True)
        lines = data.split(b"\n")
        dense[i, -6:] = [
            np.log1p(len(own)) / 10, len(raw) / w / 10, len(words) / w, times.max(initial=0) / w,
            len(set(lines)) / len(lines), float(len(own) == 0),
        ]
        bucket = (words & np.uint64(BUCKETS - 1)).astype(np.int64)
        weight = np.sqrt(times / w)
        sparse.append((bucket, weight))
    return dense, sparse


def meta_features(source, lang, n_chars) -> np.ndarray:
    """Three buckets per row: source, language and order of length; META columns in all."""
    out = np.zeros((len(source), 3), np.int64)
    for i, (s, g, n) in enumerate(zip(source, lang, n_chars, strict=True)):
        out[i, 0] = _name(s) % 80
        out[i, 1] = 80 + _name(g) % 24
        out[i, 2] = 104 + (0 if n is None else 1 + min(22, int(np.log2(max(float(n), 1.0)) * 1.2)))
    return out


def _name(value: str | None) -> int:
    return 0 if value is None else 1 + sum((i + 1) * b * 2654435761 for i, b in enumerate(value.encode("utf-8", "surrogatepass"))) % 1_000_003


def _logistic(x: np.ndarray, y: np.ndarray, l2: float, steps: int = 150) -> np.ndarray:
    """Weights (bias last) by full gradient steps with per-weight rates; classes weigh the same."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    w, seen = np.zeros(x.shape[1]), np.full(x.shape[1], 1e-8)
    share = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w.astype(x.dtype), -30, 30)))
        grad = x.T @ ((p - y) * share).astype(x.dtype) + l2 * w
        seen += grad**2
        w -= 0.3 * grad / np.sqrt(seen)
    return w


def _wide(dense: np.ndarray, sparse: list) -> np.ndarray:
    out = np.zeros((len(dense), WIDTH), np.float32)
    out[:, : dense.shape[1]] = dense
    for i, (bucket, weight) in enumerate(sparse):
        np.add.at(out[i], dense.shape[1] + bucket, weight)
    return out


def _hot(buckets: np.ndarray) -> np.ndarray:
    out = np.zeros((len(buckets), META), np.float32)
    out[np.arange(len(buckets))[:, None], buckets] = 1
    return out


@dataclass
class QualityModel:
    """Weights of both views, their calibration, how they are combined, and the threshold."""

    text: np.ndarray
    meta: np.ndarray
    platt: np.ndarray  # per view: slope, offset
    join: np.ndarray  # weight of each calibrated view, offset
    threshold: float
    constant: float | None = None

    def score(self, texts, source, lang, n_chars) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        dense, sparse = text_features(texts)
        z = dense @ self.text[: dense.shape[1]] + self.text[-1]
        z += [float(self.text[dense.shape[1] + b] @ w) for b, w in sparse]
        m = self.meta[meta_features(source, lang, n_chars)].sum(axis=1) + self.meta[-1]
        return self.combine(np.stack([z, m], axis=1))

    def combine(self, z: np.ndarray) -> np.ndarray:
        calibrated = np.clip(z * self.platt[:, 0] + self.platt[:, 1], -12, 12)
        return 1 / (1 + np.exp(-(calibrated @ self.join[:2] + self.join[2])))


def _newton(x: np.ndarray, y: np.ndarray, l2: float = 1e-2) -> np.ndarray:
    """A small logistic regression, offset last."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        r = np.maximum(p * (1 - p), 1e-6)
        w -= np.linalg.solve((x * r[:, None]).T @ x + l2 * np.eye(len(w)), x.T @ (p - y) + l2 * w)
    return w


# key, features of a text row and of its metadata
Example = tuple[int, np.ndarray, np.ndarray]
# the surest rows of each view: (view, label, example)
Surest = Callable[[list[np.ndarray], set[int]], list[tuple[int, float, Example]]]


def _strength(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


def co_train(views: list[np.ndarray], y: np.ndarray, surest: Surest, rounds: int = ROUNDS) -> QualityModel:
    """Train on labelled rows in both views; in each round a view learns from the rows the other is surest of."""
    if not len(y) or y.min() == y.max():
        return QualityModel(np.zeros(WIDTH + 1), np.zeros(META + 1), np.zeros((2, 2)), np.zeros(3), 0.0, float(y.mean()) if len(y) else 0.5)
    held = np.arange(len(y)) % 4 == 3
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held = np.zeros(len(y), bool)
    known = [([v[~held]], [y[~held]]) for v in views]

    def trained(view: int) -> np.ndarray:
        return _logistic(np.concatenate(known[view][0]), np.concatenate(known[view][1]), (1e-4, 1e-3)[view])

    weights, taken = [trained(0), trained(1)], set()
    for _ in range(rounds):
        given = surest(weights, taken)
        if not given:
            break
        for view, label, (key, *features) in given:
            known[1 - view][0].append(features[1 - view][None])
            known[1 - view][1].append(np.array([label]))
            taken.add(key)
        weights = [trained(0), trained(1)]
    check = np.flatnonzero(held) if held.any() else np.arange(len(y))
    z = np.stack([views[v][check] @ weights[v][:-1] + weights[v][-1] for v in (0, 1)], axis=1)
    platt = np.array([_newton(z[:, [v]], y[check]) for v in (0, 1)])
    calibrated = np.clip(z * platt[:, 0] + platt[:, 1], -12, 12)
    model = QualityModel(weights[0], np.append(weights[1][:META], weights[1][-1]), platt, _newton(calibrated, y[check]), 0.0)
    good = np.sort(model.combine(z)[y[check] > 0])
    model.threshold = min(0.5, float(good[int(len(good) * REFUSE)]))
    return model


class Picks:
    """The ``sure`` surest of the rows seen so far, for each view and label; equal rows once."""

    def __init__(self, sure: int = SURE, level: float = LEVEL) -> None:
        self.sure, self.level = sure, level
        self.best: dict[tuple[int, float], dict[int, tuple[float, object]]] = {(v, y): {} for v in (0, 1) for y in (1.0, 0.0)}

    def add(self, keys: np.ndarray, strengths: list[np.ndarray], make: Callable[[int], object]) -> None:
        for (view, label), held in self.best.items():
            p = strengths[view] if label else 1 - strengths[view]
            for i in np.flatnonzero(p >= self.level):
                if int(keys[i]) not in held:
                    held[int(keys[i])] = (float(p[i]), make(int(i)))
            if len(held) > 4 * self.sure:
                self.cut(view, label)

    def cut(self, view: int, label: float) -> None:
        order = sorted(self.best[view, label].items(), key=lambda x: (-x[1][0], x[0]))
        self.best[view, label] = dict(order[: self.sure])

    def rows(self) -> Iterator[tuple[int, float, int, float, object]]:
        """(view, label, key, strength, what was made of the row), the surest first."""
        for view, label in self.best:
            self.cut(view, label)
            for key, (p, made) in self.best[view, label].items():
                yield view, label, key, p, made


def fit(labelled: list, pool: list, rounds: int = ROUNDS, sure: int = SURE, level: float = LEVEL) -> QualityModel:
    """Co-training on rows (text, source, lang, n_chars, quality) held in memory; pool rows have no quality."""
    rows = [*labelled, *pool]
    text = _wide(*text_features([r[0] for r in rows]))
    meta = _hot(meta_features(*([r[i] for r in rows] for i in (1, 2, 3))))
    n = len(labelled)

    def surest(weights: list[np.ndarray], taken: set[int]) -> list[tuple[int, float, Example]]:
        ids = np.array([i for i in range(n, len(rows)) if i not in taken], int)
        picks = Picks(sure, level)
        if len(ids):
            picks.add(ids, [_strength(v[ids], w) for v, w in zip((text, meta), weights)], lambda i: None)
        return [(view, label, (key, text[key], meta[key])) for view, label, key, *_ in picks.rows()]

    return co_train([text[:n], meta[:n]], np.array([r[4] for r in labelled], float), surest, rounds)


FEATURED = "dense array<float>, bucket array<int>, weight array<float>, meta array<int>"


def _columns(dense: np.ndarray, sparse: list, meta: np.ndarray, some: list[int]) -> list[pa.Array]:
    """The features of rows as Arrow columns; a text has at most ``BUCKETS`` different buckets."""
    own = [np.unique(sparse[i][0], return_inverse=True) for i in some]
    weights = [np.bincount(at, sparse[i][1], minlength=len(b)) for i, (b, at) in zip(some, own)]
    return [
        pa.array([dense[i] for i in some], pa.list_(pa.float32())), pa.array([b for b, _ in own], pa.list_(pa.int32())),
        pa.array(weights, pa.list_(pa.float32())), pa.array([meta[i] for i in some], pa.list_(pa.int32())),
    ]


def _read(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Both views of collected rows."""
    if not table.num_rows:
        return np.zeros((0, WIDTH), np.float32), np.zeros((0, META), np.float32)
    dense = np.array(table.column("dense").to_pylist(), float).reshape(-1, WIDTH - BUCKETS)
    sparse = [(np.array(b, int), np.array(w, float)) for b, w in zip(table.column("bucket").to_pylist(), table.column("weight").to_pylist())]
    meta = np.array(table.column("meta").to_pylist(), int).reshape(len(dense), -1)
    return _wide(dense, sparse), _hot(meta)


def train(docs: DataFrame, labels: DataFrame) -> QualityModel:
    """Fit on at most ``LABELLED`` labelled rows, drawn by hash, and on the surest of all rows without a label.

    (doc_id, text, source, lang, n_chars) and (doc_id, quality). Every round reads all unlabelled rows on the executors,
    where each task keeps its ``SURE`` surest per view and label; the surest of all follow from their
    strengths, and only their features reach the driver. So the pool is the table, whatever its size.
    """
    rows = docs.select("doc_id", "text", "source", "lang", F.col("n_chars").cast("double").alias("n_chars"))
    named = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(
        F.ceil(F.avg("quality") - F.lit(0.49999)).cast("int").alias("quality")
    )
    few = named.orderBy(F.xxhash64("_id"), "_id").limit(LABELLED)
    labelled = rows.join(F.broadcast(few), rows["doc_id"] == F.col("_id")).dropDuplicates(["doc_id"])

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                dense, sparse = text_features(batch.column(2).to_pylist())
                meta = meta_features(*(batch.column(i).to_pylist() for i in (3, 4, 5)))
                made = _columns(dense, sparse, meta, list(range(batch.num_rows)))
                yield pa.record_batch([batch.column(0), batch.column(1), *made], names=["doc_id", "quality", "dense", "bucket", "weight", "meta"])

    got = labelled.select("doc_id", "quality", "text", "source", "lang", "n_chars").mapInArrow(featured, f"doc_id long, quality int, {FEATURED}")
    got = got.orderBy(F.xxhash64("doc_id"), "doc_id").toArrow()  # LABELLED rows of bounded size
    text, meta = _read(got)
    ids = named.select("_id")
    ids = F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids
    free = rows.join(ids, rows["doc_id"] == F.col("_id"), "left_anti").filter("doc_id IS NOT NULL")
    free = free.select(F.xxhash64("text", "source", "lang", "n_chars").alias("key"), "text", "source", "lang", "n_chars")

    def surest(weights: list[np.ndarray], taken: set[int]) -> list[tuple[int, float, Example]]:
        sent = docs.sparkSession.sparkContext.broadcast((weights, taken))  # two vectors, and 4 * SURE keys a round

        def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            (of_text, of_meta), gone = sent.value
            picks = Picks()
            for whole in batches:
                for at in range(0, whole.num_rows, 512):
                    batch = whole.slice(at, 512)
                    keys = batch.column(0).to_numpy(zero_copy_only=False)
                    fresh = np.array([k not in gone for k in keys.tolist()], bool)
                    batch, keys = batch.filter(pa.array(fresh, pa.bool_())), keys[fresh]
                    dense, sparse = text_features(batch.column(1).to_pylist())
                    buckets = meta_features(*(batch.column(i).to_pylist() for i in (2, 3, 4)))
                    z = dense @ of_text[: dense.shape[1]] + of_text[-1]
                    z += [float(of_text[dense.shape[1] + b] @ w) for b, w in sparse]
                    m = of_meta[buckets].sum(axis=1) + of_meta[-1]
                    strengths = [1 / (1 + np.exp(-np.clip(x, -30, 30))) for x in (z, m)]
                    picks.add(keys, strengths, lambda i: (dense[i].astype(np.float32), *sparse[i], buckets[i]))
            out = list(picks.rows())
            made = _columns([r[4][0] for r in out], [r[4][1:3] for r in out], [r[4][3] for r in out], list(range(len(out))))
            yield pa.record_batch(
                [pa.array([r[0] for r in out], pa.int32()), *(pa.array([r[i] for r in out], t) for i, t in ((1, pa.float64()), (2, pa.int64()), (3, pa.float64()))), *made],
                names=["view", "label", "key", "strength", "dense", "bucket", "weight", "meta"],
            )

        held = saved(free.mapInArrow(pick, f"view int, label double, key long, strength double, {FEATURED}"), "surest")
        out = []
        for view in (0, 1):
            for label in (1.0, 0.0):
                own = held.filter((F.col("view") == view) & (F.col("label") == label))
                # equal rows of several tasks are one row; SURE keys reach the driver, then their features
                keys = [r.key for r in own.select("key", "strength").distinct().orderBy(F.desc("strength"), "key").limit(SURE).collect()]
                rows_of = own.filter(F.col("key").isin(keys)).dropDuplicates(["key"]).orderBy(F.desc("strength"), "key").toArrow()
                a, b = _read(rows_of)
                out += [(view, label, (k, a[i], b[i])) for i, k in enumerate(rows_of.column("key").to_pylist())]
        return out

    return co_train([text, meta], np.array(got.column("quality").to_pylist(), float), surest)


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, kept) for every row of ``docs``."""
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), "source", "lang", F.col("n_chars").cast("double").alias("n_chars")
    )
    shared = docs.sparkSession.sparkContext.broadcast(train(rows, labels))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                score = shared.value.score(*(batch.column(i).to_pylist() for i in (1, 2, 3, 4)))
                yield pa.record_batch(
                    [batch.column(0), pa.array(score, pa.float64()), pa.array(score >= shared.value.threshold)], names=["doc_id", "score", "kept"]
                )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(predict, f"doc_id {kind}, score double, kept boolean")
