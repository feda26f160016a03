"""Operator 9: language ID with averaged hashed subword embeddings and a linear softmax.

The model: every character n-gram (1 to 4) of a word with borders is hashed into a row of an
embedding table; a text is the mean of its rows, a linear layer and softmax give the language.
Embeddings and layer are trained in numpy by stochastic gradient descent on pieces of labelled
texts. The training pieces are a bounded sample (`PIECES`, a documented bound): all labelled texts
are cut into pieces of `PIECE` characters, and of the different pieces of each language the same
number is drawn by hash, at least one; copies do not count. One piece in five is held back: on these a temperature is fitted,
and the confidence below which a text is rejected is set so that at most `REFUSE` of them go; it
is never above `PRIOR` times the confidence of a text of which nothing is known, so that known but
mixed texts stay.

A rejected text is one without letters, or one whose calibrated confidence is under that
threshold. Since the average is linear, scoring adds one row of per-language weights for each
n-gram, over the whole text.

Null and empty texts and texts without a letter get `und`, score 0 and are rejected. Rows with a
null language are never learned from. Without labelled rows every text is `und`. Repeated rows get
equal answers; ties go to the language that comes first by code point. Extra columns do not matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.shared import mix

BUCKETS = 1 << 16
DIM = 12
GRAMS = (1, 2, 3, 4)
PIECE = 200
PIECES = 12_000
MANY = 64
REFUSE = 0.0005
PRIOR = 1.1
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")
STEP = 1 << 20
ROWS = 512


def _ngrams(text: str) -> np.ndarray:
    """Bucket of every n-gram of the lower-cased words; what isn't a letter is a border."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.concatenate([[32], points, [32]]).astype(np.uint64)
    other = (codes < 65) | ((codes > 90) & (codes < 97)) | ((codes > 122) & (codes < 170)) | ((codes >= 0x2000) & (codes < 0x2070))
    codes[other] = 32
    space = codes == 32
    out = []
    run = np.zeros(len(codes), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        m = len(codes) - n + 1
        if m <= 0:
            break
        run = run[:m] * np.uint64(0x100000001B3) + codes[n - 1 :]
        if n in GRAMS:
            fine = ~space[:m] if n == 1 else np.ones(m, bool)
            if n > 1:  # a border only at the ends, and not alone
                for i in range(1, n - 1):
                    fine &= ~space[i : m + i]
                fine &= ~(space[:m] & space[n - 1 :]) if n > 2 else ~space[:m] | ~space[1:]
            out.append((mix(run[fine] + np.uint64(n)) & np.uint64(BUCKETS - 1)).astype(np.int32))
    return np.concatenate(out) if out else np.zeros(0, np.int32)


@dataclass
class LanguageModel:
    """`weights` are per-bucket logits (embedding times layer), already divided by the temperature.

    With many languages they are the embeddings, and `layer` (so divided) makes logits of their mean.
    """

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    threshold: float
    layer: np.ndarray | None = None

    def logits(self, text: str) -> np.ndarray:
        """Mean over all n-grams of the whole text, in steps of bounded size."""
        total, n = np.zeros(self.weights.shape[1]), 0
        for at in range(0, max(len(text), 1), STEP):
            grams = _ngrams(text[at : at + STEP])
            total += self.weights.take(grams, axis=0).sum(axis=0)
            n += len(grams)
        mean = total / max(n, 1)
        return (mean if self.layer is None else mean @ self.layer) + self.bias

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not text or not self.languages or not LETTER.search(text):
            return UNKNOWN, 0.0, True
        z = self.logits(text)
        p = np.exp(z - z.max())
        p /= p.sum()
        best = int(np.argmax(p))
        return self.languages[best], float(p[best]), bool(p[best] < self.threshold)


def _train(texts: list[str], langs: list[str], seed: int = 11, epochs: int = 4, batch: int = 64) -> LanguageModel:
    names = sorted(set(langs))
    if not names:
        return LanguageModel([], np.zeros((BUCKETS, 0)), np.zeros(0), 0.0)
    rng = np.random.default_rng(seed)
    y = np.array([names.index(x) for x in langs])
    grams = [_ngrams(t) for t in texts]
    usable = np.array([i for i, g in enumerate(grams) if len(g)], int)
    order = rng.permutation(usable)
    held, train = order[: len(order) // 5], order[len(order) // 5 :]
    seen = np.zeros(BUCKETS, bool)
    for i in train:
        seen[grams[i]] = True
    table = rng.normal(0, 0.1, (BUCKETS, DIM)) * seen[:, None]  # what was never seen stays zero
    layer, bias = rng.normal(0, 0.1, (DIM, len(names))), np.zeros(len(names))
    steps, done = max(1, epochs * (len(train) // batch + 1)), 0
    for _ in range(epochs):
        for at in range(0, len(train), batch):
            ids = train[at : at + batch]
            rate = 8.0 * (1 - done / steps) + 0.05
            done += 1
            sizes = np.array([len(grams[i]) for i in ids])
            flat = np.concatenate([grams[i] for i in ids])
            hidden = np.add.reduceat(table[flat], np.concatenate([[0], np.cumsum(sizes)[:-1]])) / sizes[:, None]
            z = hidden @ layer + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(ids)), y[ids]] -= 1
            p /= len(ids)
            back = (p @ layer.T) / sizes[:, None]
            layer -= rate * 0.1 * (hidden.T @ p)
            bias -= rate * 0.1 * p.sum(0)
            rows = np.repeat(back, sizes, axis=0)
            for d in range(DIM):
                table[:, d] -= rate * 12 * np.bincount(flat, rows[:, d], minlength=BUCKETS)
        rng.shuffle(train)
    last = layer if len(names) > MANY else None
    weights = table @ layer if last is None else table
    model = LanguageModel(names, weights, bias, 0.0, last)
    check = held if len(held) else train
    z = np.array([model.logits(texts[i]) for i in check])
    best_t, best = 1.0, np.inf
    for t in np.geomspace(0.25, 8, 41):
        q = z / t
        q = q - q.max(1, keepdims=True)
        loss = -(q[np.arange(len(check)), y[check]] - np.log(np.exp(q).sum(1))).mean()
        if loss < best:
            best_t, best = t, loss
    q = np.exp((z - z.max(1, keepdims=True)) / best_t)
    sure = np.sort((q / q.sum(1, keepdims=True)).max(1))
    prior = np.exp((bias - bias.max()) / best_t)
    threshold = min(float(sure[int(len(sure) * REFUSE)]), PRIOR * float(prior.max() / prior.sum()))
    if last is not None:
        return LanguageModel(names, weights, bias / best_t, threshold, last / best_t)
    return LanguageModel(names, weights / best_t, bias / best_t, threshold)


def train(docs: DataFrame, learn: Column | None = None, pieces: int = PIECES) -> LanguageModel:
    """Fit on the rows of ``docs`` (text, lang) for which ``learn`` holds; at most ``pieces`` pieces, or one for each language."""
    rows = docs.filter("lang IS NOT NULL AND text IS NOT NULL")
    if learn is not None:
        rows = rows.filter(learn)
    # extracting is linear in the text, substrings at all places are not
    cut = rows.select("lang", F.explode(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))).alias("piece"))
    cut = cut.withColumn("h", F.xxhash64("piece"))
    counts = cut.select("lang", "h").distinct().groupBy("lang").agg(F.count("*").alias("n")).collect()
    if not counts:
        return _train([], [])
    share = max(1, pieces // len(counts))
    # few pieces of each language are ranked; that fewer than its share pass is next to impossible
    rates = docs.sparkSession.createDataFrame([(r.lang, min(1.0, (2 * share + 40) / r.n)) for r in counts], "lang string, rate double")
    drawn = cut.join(F.broadcast(rates), "lang").filter(F.shiftrightunsigned("h", 11) < F.col("rate") * float(1 << 53))
    drawn = drawn.select("lang", "h", "piece").distinct()
    first = drawn.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.shiftrightunsigned("h", 11), "piece")))
    rows = first.filter(F.col("r") <= share).orderBy("h", "piece", "lang").select("lang", "piece").collect()
    return _train([r.piece for r in rows], [r.lang for r in rows])


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, rejected) for every row of ``docs``, from its text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages numbers

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [shared.value.predict(x.as_py()) for x in batch.column(1)]
            names, scores, refused = zip(*out, strict=True) if out else ((), (), ())
            yield pa.record_batch(
                [batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(refused, pa.bool_())],
                names=["doc_id", "lang_pred", "score", "rejected"],
            )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(predict, f"doc_id {kind}, lang_pred string, score double, rejected boolean")


def is_held_out(id_col: str = "doc_id") -> Column:
    """The fold of the contract: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def language_stage(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose language is recognised, with their own columns; all of them if no row has a language."""
    model = train(docs)
    if not model.languages:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema, at = docs.schema, docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):  # no second copy of all texts of a batch
                batch = whole.slice(start, ROWS)
                yield batch.filter(pa.array([not shared.value.predict(x.as_py())[2] for x in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(keep, schema)

