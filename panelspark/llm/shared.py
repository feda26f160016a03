"""Helpers of this subpackage: shared folders, saved tables, numpy word hashes."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words are runs of anything but the six ASCII white space characters.
SPACE = "\\x20\\x09-\\x0D"
WORD = f"[^{SPACE}]+"
A_Z, a_z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """This application's folder under ``spark.checkpoint.dir``; removed when Python ends.

    A local session without that setting gets a temporary folder; a cluster must have it.
    """
    context = spark.sparkContext
    if context.applicationId in _own:
        return _own[context.applicationId]
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="panelspark-llm-")
    folder = f"{base.rstrip('/')}/llm-{context.applicationId}-{uuid.uuid4().hex[:8]}"
    _own[context.applicationId] = folder

    def remove() -> None:
        if context._jsc is not None:
            path = context._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)

    atexit.register(remove)
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    folder = new_folder(spark, name)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def lower_ascii(text: Column) -> Column:
    return F.translate(text, A_Z, a_z)


def words(text: Column) -> Column:
    """The words of a text as an array; a null text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD})"), 1)


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


# ---- numpy inside tasks -------------------------------------------------------------------

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.default_rng(20240229).integers(1, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
SECTION = 1 << 18  # bytes hashed at once; each takes some tens of bytes of memory meanwhile


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_pow, _pow_inv = _powers(_P, 1), _powers(_P_INV, 1)


def _section_hashes(data: bytes) -> np.ndarray:
    """64-bit hashes of the words of ``data``, in order."""
    global _pow, _pow_inv
    raw = np.frombuffer(data, np.uint8)
    inside = ~_IS_SPACE[raw]
    edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    if len(_pow) < len(raw) + 1:
        _pow, _pow_inv = _powers(_P, len(raw) + 1), _powers(_P_INV, len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * _pow[: len(raw)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _pow_inv[starts] + (ends - starts).astype(np.uint64))


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of a text's words with A-Z lower-cased; long texts go in sections cut at white space."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER)
    if len(data) <= SECTION:
        return _section_hashes(data)
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + SECTION)
        if end < len(data):
            while end > at and data[end - 1] not in b"\t\n\v\f\r ":
                end -= 1
            if end == at:  # one word longer than a section
                end = at + SECTION
                while end < len(data) and data[end] not in b"\t\n\v\f\r ":
                    end += 1
        out.append(_section_hashes(data[at:end]))
        at = end
    return np.concatenate(out)


def batch_word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of several texts, and the number of words of each; small texts share passes."""
    hashes, counts, group, size = [], np.zeros(len(texts), np.int64), [], 0

    def flush() -> None:
        nonlocal group, size
        if group:
            data = b" ".join(x for _, x in group)
            raw = np.frombuffer(data, np.uint8)
            inside = ~_IS_SPACE[raw]
            starts = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
            borders = np.cumsum([len(x) + 1 for _, x in group])
            upto = np.searchsorted(starts, borders)
            counts[[i for i, _ in group]] = np.diff(upto, prepend=0)
            hashes.append(_section_hashes(data))
        group, size = [], 0

    for i, text in enumerate(texts):
        data = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER)
        if len(data) > SECTION:
            flush()
            own = word_hashes(text)
            counts[i] = len(own)
            hashes.append(own)
            continue
        if size + len(data) > SECTION:
            flush()
        group.append((i, data))
        size += len(data) + 1
    flush()
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), counts


def local_path(uri: str) -> str | None:
    """The path of a ``file:`` folder, else None."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if uri.startswith(os.sep) else None
