"""Operator 5: exact repeated strings by column-wise suffix sorting of many documents.

Every byte covered by a string of `LENGTH` bytes that also starts elsewhere in the table is found.
Suffixes are sorted by inserting one symbol of every document per round, right to left, into the
Burrows-Wheeler transform of the collection: the place of each new suffix follows from a stable
count of the symbols before it. Neighbours in the final order that have `LENGTH` bytes in common
are repeats.

As many rounds as the longest document is long would not end on a cluster, and one collection would
be one task. So the documents of a collection are short segments that are sure to meet. In every
window of `LENGTH` bytes the least hash of its `CORE`-byte substrings names the window; successive
windows with the same least substring form a segment of fewer than 2 * LENGTH bytes. Equal windows
have equal names, so only segments with the same name can share one. From names to result:

1. a name that only one place has is dropped (hash aggregation, no sort);
2. equal segments are one with several places, and then repeated as a whole;
3. names with several different segments go to one collection each; collections are packed to
   about `PACK` bytes and sorted column by column in memory;
4. a name with more than `MOST` different segments is not gathered: its windows are counted by
   128-bit hash in the same exact way.

Memory per task is a pack and a few arrays of the text at hand. Texts of one content are one
document with copies; with two copies all of it is repeated. Null and empty texts and those under
`LENGTH` bytes lose nothing. Rows that share an id but not a text are different documents; repeated
rows are copies. Null ids are allowed. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.shared import _BYTE, _P, _P_INV, _powers, mix, saved

LENGTH = 200
CORE = 64
PACK = 1 << 17
MOST = 20_000
SECTION = 1 << 20  # bytes of a text that are named at a time
_EMPTY = hashlib.sha256(b"").hexdigest()

_pow, _inv = _powers(_P, SECTION + 2 * LENGTH), _powers(_P_INV, SECTION + 2 * LENGTH)


def _sums(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _pow[: len(data)], out=out[1:])
    return out


def _hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((sums[ends] - sums[starts]) * _inv[starts])


def _least_in_windows(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` successive values: minima from block borders both ways."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def segments(data: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Names, starts and ends of the segments of a text, section by section.

    Segments of neighbouring sections overlap in LENGTH - 1 bytes and share no window.
    """
    raw = np.frombuffer(data, np.uint8)
    for at in range(0, max(0, len(raw) - LENGTH + 1), SECTION):
        part = raw[at : at + SECTION + LENGTH - 1]
        sums = _sums(part)
        place = np.arange(len(part) - CORE + 1)
        hashes = _hash(sums, place, place + CORE)
        # leftmost of equal hashes: the place is in the low bits
        least = _least_in_windows((hashes & ~np.uint64((1 << 21) - 1)) | place.astype(np.uint64), LENGTH - CORE + 1)
        first = np.flatnonzero(np.diff(least, prepend=least[:1] + np.uint64(1)))
        name = hashes[(least[first] & np.uint64((1 << 21) - 1)).astype(np.int64)]
        last = np.append(first[1:], len(least)) - 1
        yield name, first + at, last + at + LENGTH


def _content(data: bytes) -> tuple[int, int]:
    digest = hashlib.blake2b(data, digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def suffix_order(texts: list[bytes]) -> np.ndarray:
    """Starts, in the joined texts, of all their non-empty suffixes in sorted order.

    Round j inserts the suffixes of length j. `bwt` has the symbol before every suffix in the
    current order (0: none yet), `place` where each text's newest suffix lies in it.
    """
    lengths = np.array([len(x) for x in texts])
    joined = np.frombuffer(b"".join(texts), np.uint8)
    ends, m = np.cumsum(lengths), len(texts)
    # arrays of the final size, used again in every round
    total = m + len(joined)
    steps, rank, old = np.arange(total, dtype=np.int32), np.empty(total, np.int32), np.ones(total, bool)
    bwt, grown = np.zeros(total, np.uint8), np.zeros(total, np.uint8)
    n, place = m, np.arange(m)

    def ranked() -> np.ndarray:
        """The place of each suffix with the symbol before it, but for a constant: a stable count."""
        rank[np.argsort(bwt[:n], kind="stable")] = steps[:n]
        return rank

    for j in range(1, int(lengths.max(initial=0)) + 1):
        going = np.flatnonzero(lengths >= j)
        bwt[place[going]] = joined[ends[going] - j] + 1  # UTF-8 has no byte 255
        # the m empty suffixes come first, and texts that have ended go no further
        to = ranked()[place[going]] + len(going)
        size = n + len(going)
        old[to] = False
        grown[:size][old[:size]] = bwt[:n]
        grown[to] = 0
        if len(going) < m:  # suffixes of texts that have ended keep their place among the others
            done = np.flatnonzero(lengths < j)
            place[done] = np.flatnonzero(old[:size])[place[done]]
        old[to] = True
        place[going] = to
        bwt, grown, n = grown, bwt, size
    # once more along the transform: which suffix lies where
    order = np.full(n, -1)
    follow, at = ranked()[:n] - int((bwt[:n] == 0).sum()) + m, np.arange(m)
    for j in range(1, int(lengths.max(initial=0)) + 1):
        going = np.flatnonzero(lengths >= j)
        at[going] = follow[at[going]]
        order[at[going]] = ends[going] - j
    return order[m:]


def repeated_windows(texts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each text, the starts of its windows that also start elsewhere in ``texts``."""
    if not texts:
        return []
    joined = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(x) for x in texts])
    order = suffix_order(texts)
    left = ends[np.searchsorted(ends, order, side="right")] - order
    starts = order[left >= length]
    again = np.zeros(len(starts), bool)
    if len(starts) > 1:
        windows = np.lib.stride_tricks.sliding_window_view(joined, length)
        for at in range(0, len(starts) - 1, 1 << 14):
            some = starts[at : at + (1 << 14) + 1]
            rows = windows[some]
            same = (rows[1:] == rows[:-1]).all(axis=1)
            again[at : at + len(same)] |= same
            again[at + 1 : at + 1 + len(same)] |= same
    found = np.sort(starts[again])
    owner = np.searchsorted(ends, found, side="right")
    begins = ends - [len(x) for x in texts]
    borders = np.searchsorted(owner, np.arange(len(begins) + 1))
    return [found[a:b] - begin for a, b, begin in zip(borders[:-1], borders[1:], begins, strict=True)]


def _runs(starts: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) of runs of successive numbers."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) != 1)
    return list(zip(starts[np.append(0, cut + 1)].tolist(), starts[np.append(cut, len(starts) - 1)].tolist(), strict=True))


# ---- steps in tasks -------------------------------------------------------------------------

_NAMES = "name long, t long, i long"


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(t, text) to (name, t, i)."""
    for whole in batches:
        for at in range(0, whole.num_rows, 512):
            batch, out = whole.slice(at, 512), []
            for t, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                out += [(name, np.full(len(name), t, np.int64), start) for name, start, _ in segments(_bytes(text.as_py()))]
            if out:
                name, t, i = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.record_batch([_signed(name), pa.array(t), pa.array(i.astype(np.int64))], names=["name", "t", "i"])


def _wanted(with_bytes: bool):
    """(t, u, text, starts) to the segments with these starts."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                rows = []
                for t, u, text, starts in zip(*(c.to_pylist() for c in whole.slice(at, 128).columns), strict=True):
                    data, want = _bytes(text), np.array(starts)
                    for name, begin, end in segments(data):
                        hit = np.flatnonzero(np.isin(begin, want))
                        for n, a, b in zip(name[hit].view(np.int64).tolist(), begin[hit].tolist(), end[hit].tolist(), strict=True):
                            piece = data[a:b]
                            rows.append((n, *_content(piece), piece) if with_bytes else (n, *_content(piece), t, u, a, b - a - LENGTH))
                if rows:
                    kinds = [pa.int64()] * 3 + ([pa.binary()] if with_bytes else [pa.int64()] * 4)
                    names = ["name", "s1", "s2"] + (["data"] if with_bytes else ["t", "u", "i", "last"])
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return spread


def _sorted_packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments (name, s1, s2, data) ordered by name to (s1, s2, lo, hi): runs of repeated windows."""
    pack, size, last = [], 0, None

    def solved() -> pa.RecordBatch:
        rows = [(s1, s2, lo, hi) for (s1, s2, _), found in zip(pack, repeated_windows([x for *_, x in pack]), strict=True) for lo, hi in _runs(found)]
        return pa.record_batch([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 4)], names=["s1", "s2", "lo", "hi"])

    for batch in batches:
        for name, s1, s2, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if name != last and size >= PACK:
                yield solved()
                pack, size = [], 0
            if not (pack and pack[-1][:2] == (s1, s2)):
                pack.append((s1, s2, data))
                size += len(data)
            last = name
    if pack:
        yield solved()


def _window_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window of (s1, s2, data) with two hashes."""
    for whole in batches:
        for s1, s2, data in zip(*(c.to_pylist() for c in whole.columns), strict=True):
            raw = np.frombuffer(data, np.uint8)
            place = np.arange(len(raw) - LENGTH + 1)
            one = _hash(_sums(raw), place, place + LENGTH)
            two = _hash(_sums(raw ^ 0x5A), place, place + LENGTH)
            n = len(place)
            yield pa.record_batch(
                [_signed(one), _signed(two), pa.array(np.full(n, s1, np.int64)), pa.array(np.full(n, s2, np.int64)), pa.array(place.astype(np.int64))],
                names=["h1", "h2", "s1", "s2", "lo"],
            )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(t, u, text, runs of window starts) to what is left of each text."""
    for whole in batches:
        rows = []
        for t, u, text, runs in zip(*(c.to_pylist() for c in whole.columns), strict=True):
            data = _bytes(text)
            spans: list[list[int]] = []
            for lo, hi in sorted((r["lo"], r["hi"]) for r in runs):
                if spans and lo <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], hi + LENGTH)
                else:
                    spans.append([lo, hi + LENGTH])
            left, at = hashlib.sha256(), 0
            for lo, hi in spans:
                left.update(data[at:lo])
                at = hi
            left.update(data[at:])
            rows.append((t, u, sum(b - a for a, b in spans), len(spans), left.hexdigest()))
        if rows:
            kinds = [pa.int64()] * 4 + [pa.string()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["t", "u", "n_removed", "n_spans", "kept_sha256"])


# ---- the job ------------------------------------------------------------------------------


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row of ``docs``."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumns({"t": F.xxhash64("text"), "u": F.xxhash64(F.lit("u"), "text")})
    narrow = rows.select("doc_id", "t", "u", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha"))
    contents = saved(
        narrow.groupBy("t", "u").agg(F.min("doc_id").alias("lead"), F.count("*").alias("copies")), "contents"
    )
    # names at several places
    named = rows.select("t", "text").mapInArrow(_named, _NAMES)
    spot = F.xxhash64("t", "i")
    shared = named.groupBy("name").agg(F.min(spot).alias("a"), F.max(spot).alias("b")).filter("a < b").select("name")
    wanted = named.join(shared, "name").select("t", "i").distinct().groupBy("t").agg(F.collect_list("i").alias("starts"))
    wanted = saved(wanted, "wanted")
    # the texts that hold one, each content once
    lead = contents.join(wanted, "t").withColumnsRenamed({"t": "lt", "u": "lu"})
    same = rows["doc_id"].eqNullSafe(F.col("lead")) & (rows["t"] == F.col("lt")) & (rows["u"] == F.col("lu"))
    texts = saved(rows.join(lead, same).select("t", "u", "text", "starts"), "texts")
    # equal segments are one; `whole` are repeated from end to end
    members = saved(
        texts.mapInArrow(_wanted(False), "name long, s1 long, s2 long, t long, u long, i long, last long").distinct(), "places"
    )
    kinds = members.groupBy("name", "s1", "s2").agg(
        F.count("*").alias("n"), F.min(F.struct("t", "u", "i")).alias("owner")
    )
    kinds = saved(kinds, "segments")
    many = kinds.groupBy("name").agg(F.count("*").alias("c")).filter("c > 1")
    open_ = kinds.join(many, "name")
    owners = open_.select("owner.t", "owner.u", "owner.i", (F.col("c") > most).alias("large"))

    def with_bytes(some: DataFrame) -> DataFrame:
        starts = some.groupBy("t", "u").agg(F.collect_list("i").alias("own"))
        return texts.drop("starts").join(starts, ["t", "u"]).select("t", "u", "text", "own").mapInArrow(
            _wanted(True), "name long, s1 long, s2 long, data binary"
        )

    small = with_bytes(owners.filter("NOT large")).repartition("name").sortWithinPartitions("name", "s1", "s2")
    runs = saved(small.mapInArrow(_sorted_packs, "s1 long, s2 long, lo long, hi long"), "runs")
    if owners.filter("large").limit(1).count():
        hashes = with_bytes(owners.filter("large")).select("s1", "s2", "data").mapInArrow(
            _window_hashes, "h1 long, h2 long, s1 long, s2 long, lo long"
        )
        at = F.xxhash64("s1", "s2", "lo")
        twice = hashes.groupBy("h1", "h2").agg(F.min(at).alias("a"), F.max(at).alias("b")).filter("a < b").select("h1", "h2")
        counted = hashes.join(twice, ["h1", "h2"]).select("s1", "s2", "lo", F.col("lo").alias("hi"))
        runs = runs.union(saved(counted, "counted"))
    # back to the texts: shifted by the start of each place
    placed = members.join(runs, ["s1", "s2"]).select("t", "u", (F.col("i") + F.col("lo")).alias("lo"), (F.col("i") + F.col("hi")).alias("hi"))
    whole = members.join(kinds.filter("n > 1").select("name", "s1", "s2"), ["name", "s1", "s2"]).select(
        "t", "u", F.col("i").alias("lo"), (F.col("i") + F.col("last")).alias("hi")
    )
    spans = placed.union(whole).groupBy("t", "u").agg(F.collect_set(F.struct("lo", "hi")).alias("runs"))
    left = texts.drop("starts").join(spans, ["t", "u"]).select("t", "u", "text", "runs").mapInArrow(
        _cut, "t long, u long, n_removed long, n_spans long, kept_sha256 string"
    ).dropDuplicates(["t", "u"])
    known = contents.select("t", "u", "copies").join(left, ["t", "u"], "left")
    out = narrow.join(known, ["t", "u"])
    gone = (F.col("copies") > 1) & (F.col("n_bytes") >= LENGTH)
    return out.select(
        "doc_id", "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.lit(_EMPTY)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )
