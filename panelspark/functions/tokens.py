"""Series as token text: scale to [-0.5, 0.5], snap to bin centres, write as marked decimals."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelspark.operators.windows import mean_of
from panelspark.params import N_BINS, TOKEN_FORMAT, TOKEN_PATTERN, TOKEN_SEPARATOR

WIDTH = 2.0 / N_BINS


def _edge(k: Column) -> Column:
    return k * F.lit(WIDTH) + F.lit(-1.0)


def scale_window(values: Column) -> Column:
    """Min-max to [-0.5, 0.5]; a constant window becomes zeros."""
    low, high = F.array_min(values), F.array_max(values)
    return F.transform(
        values, lambda v: F.when(high == low, F.lit(0.0)).otherwise((v - low) / (high - low) - 0.5)
    )


def bin_index(v: Column) -> Column:
    """Number of inner edges below ``v``: direct formula, set right by one at most where rounding bites."""
    clipped = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v))
    guess = F.greatest(F.lit(0), F.least(F.lit(N_BINS - 1), F.ceil((clipped + 1.0) / WIDTH) - 1))
    up = F.when((guess < N_BINS - 1) & (_edge(guess + 1) < clipped), 1).otherwise(0)
    down = F.when((guess > 0) & (_edge(guess) >= clipped), 1).otherwise(0)
    return guess + up - down


def snap(v: Column) -> Column:
    """Centre of the bin ``v`` falls in."""
    k = bin_index(v)
    return (_edge(k) + _edge(k + 1)) / 2


def write_tokens(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda v: F.format_string(TOKEN_FORMAT, v)), TOKEN_SEPARATOR)


def encode(values: Column) -> Column:
    """Token text of a window."""
    return write_tokens(F.transform(scale_window(values), snap))


def encode_future(values: Column, history: Column) -> Column:
    """Token text of later values on the scale of ``history``, clipped to its range."""
    low, high = F.array_min(history), F.array_max(history)

    def scaled(v: Column) -> Column:
        x = (v - low) / (high - low + 1e-8) - 0.5
        return F.rint(F.greatest(F.lit(-0.5), F.least(F.lit(0.5), x)) * 10000) / 10000

    return write_tokens(F.transform(values, scaled))


def read_tokens(text: Column, horizon: Column) -> Column:
    """First ``horizon`` token values found in a text."""
    found = F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(1))
    return F.transform(F.slice(found, 1, horizon), lambda x: x.cast("double"))


def unscale(values: Column, history: Column) -> Column:
    low, high = F.array_min(history), F.array_max(history)
    return F.transform(values, lambda v: F.when(high == low, low).otherwise((v + 0.5) * (high - low) + low))


def fit_length(values: Column, horizon: Column) -> Column:
    """Cut to ``horizon``, or repeat the last value up to it."""
    missing = F.greatest(F.lit(0), horizon - F.size(values))
    return F.slice(F.concat(values, F.array_repeat(F.element_at(values, -1), missing)), 1, horizon)


def random_walk(history: Column, horizon: Column, key: Column, seed: int = 42) -> Column:
    """Walk from the last value with the window's daily volatility.

    Steps are normal numbers derived from a hash of (key, step, seed), so a rerun
    task produces the same walk whatever the partitioning.
    """
    steps = F.zip_with(
        F.slice(history, 2, F.size(history) - 1), F.slice(history, 1, F.size(history) - 1), lambda b, a: b - a
    )
    centre = mean_of(steps)
    spread = F.sqrt(F.aggregate(steps, F.lit(0.0), lambda a, x: a + (x - centre) * (x - centre)) / F.size(steps))
    last = F.element_at(history, -1)
    vol = F.when(F.size(history) > 1, spread).otherwise(last * 0.001)
    big = 1 << 52

    def uniform(k: Column, salt: int) -> Column:
        return (F.pmod(F.xxhash64(key, k, F.lit(seed), F.lit(salt)), F.lit(big)) + 0.5) / float(big)

    def normal(k: Column) -> Column:
        return F.sqrt(-2 * F.log(uniform(k, 1))) * F.cos(uniform(k, 2) * (2 * math.pi))

    return F.transform(
        F.sequence(F.lit(1), horizon),
        lambda k: last
        + F.aggregate(F.transform(F.sequence(F.lit(1), k), lambda j: normal(j) * vol), F.lit(0.0), lambda a, x: a + x),
    )


def decode(text: Column, history: Column, horizon: Column, fallback: Column | None = None) -> Column:
    """Prices from token text; without any token ``fallback`` (default: last price, flat)."""
    tokens = read_tokens(text, horizon)
    flat = F.array_repeat(F.element_at(history, -1), horizon)
    return F.when(F.size(tokens) > 0, fit_length(unscale(tokens, history), horizon)).otherwise(
        flat if fallback is None else fallback
    )


def has_tokens(text: Column) -> Column:
    return text.rlike(TOKEN_PATTERN)
