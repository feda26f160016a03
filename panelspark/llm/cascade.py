"""Operator 11: quality rules as a short-circuit cascade.

A rule rejects a text by a few features. Rules are tried one after another and the first that
rejects ends the work on a document, so the order decides what it costs, never what is kept. On a
sample every feature is timed and every rule tried; the outcome of all rules together is counted.
The next rule is always the one that rejects most of the documents still left per second it adds:
features that an earlier rule has made are free for later ones, and rules that reject the same
documents as an earlier one fall back.

Documents go through the cascade in Arrow batches; nothing is shuffled but the counts of the
sample. Words are runs of anything but the six ASCII white space characters, lines end at line
feeds. A text is read in sections of ``SECTION`` bytes cut at white space into word numbers, so
memory is a few numbers per word of one text. A null text is an empty one: no words, so the rule on
short texts rejects it. A line counts as repeated if it has a word and equals an earlier line;
words are repeated if they lie in a window of three words that the text has twice, the first one
included. Repeated rows and rows without an id are rows like others, extra columns are ignored by
:func:`rate` and kept by :func:`keep_good`. An empty table gives an empty one; without a sample
the rules run as declared.

``ROWS`` rows are sampled (about; each row with the same chance). A measured order may differ from
run to run; verdicts do not depend on it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from functools import cached_property
from time import perf_counter
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

ROWS = 4_000
SECTION = 1 << 22
SPACES = " \t\n\v\f\r"
# fixed values: characters that count as symbols
SYMBOLS = "#*$%&|<>"
LETTER = re.compile(rb"[A-Za-z\x80-\xff]")
SHOUTED = re.compile(rb"[^a-z]*[A-Z][^a-z]*[A-Z][^a-z]*")


class Features:
    """What rules look at in one text; each is made when first asked for."""

    def __init__(self, text: str | None) -> None:
        self.text = text or ""

    @cached_property
    def words(self) -> tuple[np.ndarray, list[bytes]]:
        """Numbers of the words in order, and the different words."""
        data, known, parts, at = self.text.encode("utf-8", "surrogatepass"), {}, [], 0
        while at < len(data):
            end = at + SECTION
            while end < len(data) and data[end : end + 1] not in (b" ", b"\t", b"\n", b"\v", b"\f", b"\r"):
                end += 1
            found = data[at:end].split()
            parts.append(np.fromiter((known.setdefault(w, len(known)) for w in found), np.int64, len(found)))
            at = end
        return (np.concatenate(parts) if parts else np.zeros(0, np.int64)), list(known)

    @cached_property
    def counts(self) -> np.ndarray:
        """How often each different word occurs."""
        return np.bincount(self.words[0], minlength=len(self.words[1]))

    @cached_property
    def n_words(self) -> int:
        return len(self.words[0])

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, SPACES))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> tuple[int, int]:
        """Lines with a word, and those of them that equal an earlier line."""
        filled = [x for x in self.text.split("\n") if x.strip(SPACES)]
        return len(filled), len(filled) - len(set(filled))

    @cached_property
    def n_dup_lines(self) -> int:
        return self.lines[1]

    @cached_property
    def n_repeat_words(self) -> int:
        ids, n = self.words[0], len(self.words[1])
        if len(ids) < 4:
            return 0
        pairs = ids[:-1] * n + ids[1:]
        if n >= 1 << 21:
            pairs = np.unique(pairs, return_inverse=True)[1]
        _, which, times = np.unique(pairs[:-1] * n + ids[2:], return_inverse=True, return_counts=True)
        at = np.flatnonzero(times[which] > 1)
        covered = np.zeros(len(ids), bool)
        for k in range(3):
            covered[at + k] = True
        return int(covered.sum())

    @cached_property
    def n_letterless(self) -> int:
        """Words without a letter (A-Z, a-z or any character beyond ASCII)."""
        return int(self.counts[[not LETTER.search(w) for w in self.words[1]]].sum()) if self.n_words else 0

    @cached_property
    def n_shouted(self) -> int:
        """Words with two letters of A-Z and none of a-z."""
        return int(self.counts[[bool(SHOUTED.fullmatch(w)) for w in self.words[1]]].sum()) if self.n_words else 0

    @cached_property
    def most_frequent(self) -> int:
        return int(self.counts.max()) if self.n_words else 0


# what a feature is made from, in an order in which everything comes after its parts
FEATURES: dict[str, tuple[str, ...]] = {
    "words": (), "counts": ("words",), "n_words": ("words",), "word_chars": (), "n_symbols": (), "lines": (),
    "n_dup_lines": ("lines",), "n_repeat_words": ("words",), "n_letterless": ("counts",), "n_shouted": ("counts",),
    "most_frequent": ("counts",),
}
REPORTED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


class Rule(NamedTuple):
    name: str
    needs: tuple[str, ...]
    rejects: Callable[[Features], bool]


BASE = (
    Rule("short", ("n_words",), lambda f: f.n_words < 50),
    Rule("repeats", ("n_words", "n_repeat_words"), lambda f: 100 * f.n_repeat_words > 50 * f.n_words),
)
# limits on shares as published for large web corpora; a share of a handful of lines says nothing
MORE = (
    Rule("symbols", ("n_words", "n_symbols"), lambda f: 10 * f.n_symbols > f.n_words),
    Rule("word_length", ("n_words", "word_chars"), lambda f: not 3 * f.n_words <= f.word_chars <= 10 * f.n_words),
    Rule("letterless", ("n_words", "n_letterless"), lambda f: 10 * f.n_letterless > 2 * f.n_words),
    Rule("dup_lines", ("lines",), lambda f: f.lines[0] >= 10 and 10 * f.lines[1] > 3 * f.lines[0]),
    Rule("shouting", ("n_words", "n_shouted"), lambda f: 2 * f.n_shouted > f.n_words),
    Rule("one_word", ("n_words", "most_frequent"), lambda f: 10 * f.most_frequent > 3 * f.n_words),
)
RULES = BASE + MORE


class Step(NamedTuple):
    """A rule in its place: seconds it adds per document, and the share of documents left that it rejects."""

    rule: Rule
    seconds: float
    rejection: float


def _parts(needs: Sequence[str]) -> set[str]:
    out: set[str] = set()
    for name in needs:
        out |= {name} | _parts(FEATURES[name])
    return out


def estimate(docs: DataFrame, rules: Sequence[Rule] = RULES, rows: int = ROWS, text: str = "text") -> pd.DataFrame:
    """On a sample: how often each combination of outcomes occurs, with the seconds each feature took.

    Columns are ``outcome`` (bit k: rule k rejects), ``n`` and one per feature. Tasks add up their own
    part, so at most one row per task and combination is shuffled; the result has no more rows than the sample.
    """
    names, tried = list(FEATURES), list(rules)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[int, np.ndarray] = {}
        for batch in batches:
            for value in batch[text]:
                made, took = Features(value), np.zeros(1 + len(names))
                took[0] = 1
                for k, name in enumerate(names, 1):
                    start = perf_counter()
                    getattr(made, name)
                    took[k] = perf_counter() - start
                outcome = sum(1 << k for k, rule in enumerate(tried) if rule.rejects(made))
                seen[outcome] = seen.get(outcome, 0) + took
        yield pd.DataFrame([[o, *t] for o, t in seen.items()], columns=["outcome", "n", *names])

    total = docs.count()
    some = docs.select(text).sample(min(1.0, rows / total), 11) if total > rows else docs.select(text)
    schema = "outcome long, n double, " + ", ".join(f"{n} double" for n in names)
    found = some.mapInPandas(measure, schema).groupBy("outcome").sum("n", *names).toPandas()
    found.columns = ["outcome", "n", *names]
    return found


def order_rules(sample: pd.DataFrame, rules: Sequence[Rule] = RULES, free: Sequence[str] = ()) -> list[Step]:
    """The rules by rejected documents per second among those the earlier ones leave.

    ``free`` features are made anyway and cost nothing. Equal rules keep the order declared.
    """
    made, left, out = _parts(free), list(enumerate(rules)), []
    n = sample["n"].sum()
    each = {f: sample[f].sum() / n if n else 0.0 for f in FEATURES}
    outcomes, weights = sample["outcome"].to_numpy(np.int64), sample["n"].to_numpy(float)
    alive = np.ones(len(sample), bool)
    while left:
        here = weights[alive].sum()

        def worth(item: tuple[int, Rule]) -> tuple[float, float, float]:
            k, rule = item
            # a test by itself costs about as much as a cheap feature
            seconds = 1e-7 + sum(each[f] for f in _parts(rule.needs) - made)
            hit = weights[alive & (outcomes >> k & 1 > 0)].sum() / here if here else 0.0
            return hit / seconds, seconds, hit

        best = max(left, key=lambda item: (worth(item)[0], -item[0]))
        _, seconds, hit = worth(best)
        out.append(Step(best[1], seconds, hit))
        left.remove(best)
        made |= _parts(best[1].needs)
        alive &= outcomes >> best[0] & 1 == 0
    return out


def plan(docs: DataFrame, rules: Sequence[Rule] = RULES, free: Sequence[str] = (), rows: int = ROWS, text: str = "text") -> list[Step]:
    """The cascade for these documents."""
    return order_rules(estimate(docs, rules, rows, text), rules, free)


def verdict(made: Features, steps: Sequence[Step]) -> tuple[str | None, int]:
    """The first rule that rejects (None: none does), and how many rules were tried."""
    for k, step in enumerate(steps, 1):
        if step.rule.rejects(made):
            return step.rule.name, k
    return None, len(steps)


def rate(docs: DataFrame, steps: Sequence[Step] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, reported features, base_failed, kept, failed_rule, rules_run) for every row.

    The reported features and the base rules hold for all rows; the cascade of the other rules
    starts on rows the base rules leave. ``failed_rule`` and ``rules_run`` follow the order in ``steps``.
    """
    steps = plan(docs, MORE, REPORTED, text=text) if steps is None else list(steps)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for value in batch[text]:
                made = Features(value)
                base = next((r.name for r in BASE if r.rejects(made)), None)
                failed, tried = (base, 0) if base else verdict(made, steps)
                rows.append((*(getattr(made, n) for n in REPORTED), base is not None, failed is None, failed, tried))
            columns = [*REPORTED, "base_failed", "kept", "failed_rule", "rules_run"]
            out = pd.DataFrame(rows, columns=columns)
            out.insert(0, "_key", batch["_key"].to_numpy())
            yield out

    # the key goes through as text, which holds any integer and null
    schema = "_key string, " + ", ".join(f"{n} long" for n in REPORTED) + ", base_failed boolean, kept boolean, failed_rule string, rules_run long"
    rows = docs.select(docs[key].cast("string").alias("_key"), docs[text].alias(text)).mapInPandas(run, schema)
    return rows.withColumn("_key", rows["_key"].cast(docs.schema[key].dataType)).withColumnRenamed("_key", key)


def keep_good(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """The rows that no rule rejects, with all their columns."""
    steps, at = plan(docs, rules, text=text), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [verdict(Features(v.as_py()), steps)[0] is None for v in batch.column(at)]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
