"""Operator 2: token ids in bit planes.

Documents are dealt by ranges of their id and sorted, each task encodes its texts and writes one
shard. A shard file is

    magic | blocks | footer | length of the footer (8 bytes) | magic

A block holds `BLOCK` ids (the last one less). Its ids are transposed: plane i has bit i of every
id, planes above the largest id are left out, and every plane is compressed with zstandard by
itself. The footer, compressed JSON, is the chunk index: offset, number of ids and plane lengths of
each block, then the ids and lengths of the documents. A block can be read without the others.

Files are written under a temporary name and renamed, so a task that runs again replaces its shard
by the same bytes. Reading yields one row per document.

Encoding: the tokenizer splits at white space first, so a text's ids are those of its words between
blanks in turn; the ids of a word are looked up in a bounded cache and encoded once per cache.

Null and empty texts are just the end id. Rows are ordered by id (null first), ties by text hash and
then text, so repeated rows follow each other. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import gc
import json
import os
import struct
import unicodedata
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.shared import local_path, new_folder, saved

MAGIC = b"BITPLN01"
BLOCK = 1 << 16
END = 2
TOKENIZER = "word_bpe_49k.json"
CACHE = 48 << 20  # bytes
SLICE_BYTES = 2 << 20
LEVEL = 1


# ---- blocks -------------------------------------------------------------------------------


def pack_block(ids: np.ndarray, level: int = LEVEL) -> list[bytes]:
    """The compressed bit planes of up to BLOCK ids, lowest bit first."""
    n = int(ids.max()).bit_length() if len(ids) else 0
    pack = zstandard.ZstdCompressor(level=level)
    return [pack.compress(np.packbits(((ids >> np.uint32(i)) & np.uint32(1)).astype(np.uint8)).tobytes()) for i in range(n)]


def unpack_block(planes: list[bytes], n: int) -> np.ndarray:
    out = np.zeros(n, np.uint32)
    unpack = zstandard.ZstdDecompressor()
    for i, plane in enumerate(planes):
        bits = np.unpackbits(np.frombuffer(unpack.decompress(plane, max_output_size=(n + 7) // 8), np.uint8), count=n)
        out |= bits.astype(np.uint32) << np.uint32(i)
    return out


class ShardWriter:
    """Writes one shard; ids come in pieces of any size."""

    def __init__(self, out, block: int = BLOCK):
        self.out, self.block, self.at = out, block, len(MAGIC)
        self.left: list[np.ndarray] = []
        self.n_left = 0
        self.blocks: list[list] = []
        self.docs: list = []
        self.lengths: list[int] = []
        out.write(MAGIC)

    def add(self, docs: list, lengths: list[int], ids: np.ndarray) -> None:
        self.docs += docs
        self.lengths += lengths
        self.left.append(ids)
        self.n_left += len(ids)
        if self.n_left >= self.block:
            whole = np.concatenate(self.left)
            full = len(whole) // self.block * self.block
            for i in range(0, full, self.block):
                self._put(whole[i : i + self.block])
            self.left, self.n_left = [whole[full:]], len(whole) - full

    def _put(self, ids: np.ndarray) -> None:
        planes = pack_block(ids)
        self.blocks.append([self.at, len(ids), [len(x) for x in planes]])
        for plane in planes:
            self.out.write(plane)
            self.at += len(plane)

    def close(self) -> None:
        if self.n_left:
            self._put(np.concatenate(self.left))
        footer = {"blocks": self.blocks, "docs": self.docs, "lengths": self.lengths}
        data = zstandard.ZstdCompressor(level=LEVEL).compress(json.dumps(footer).encode())
        self.out.write(data + struct.pack("<Q", len(data)) + MAGIC)


class ShardReader:
    """Random access to a shard: the index first, then single blocks."""

    def __init__(self, source):
        self.source = source
        source.seek(-8 - len(MAGIC), os.SEEK_END)
        tail = source.read(8 + len(MAGIC))
        if tail[8:] != MAGIC:
            raise ValueError("not a bit-plane shard, or cut short")
        size = struct.unpack("<Q", tail[:8])[0]
        source.seek(-8 - len(MAGIC) - size, os.SEEK_END)
        footer = json.loads(zstandard.ZstdDecompressor().decompress(source.read(size)))
        self.blocks, self.docs, self.lengths = footer["blocks"], footer["docs"], footer["lengths"]

    def block(self, i: int) -> np.ndarray:
        at, n, sizes = self.blocks[i]
        self.source.seek(at)
        return unpack_block([self.source.read(x) for x in sizes], n)

    def documents(self) -> Iterator[tuple[object, np.ndarray]]:
        """(doc_id, ids), one block in memory at a time besides the document's own ids."""
        buffer, i = np.zeros(0, np.uint32), 0
        at = 0
        for doc, n in zip(self.docs, self.lengths, strict=True):
            if len(buffer) - at < n:
                parts, have = [buffer[at:]], len(buffer) - at
                while have < n:
                    parts.append(self.block(i))
                    have += len(parts[-1])
                    i += 1
                buffer, at = np.concatenate(parts), 0
            yield doc, buffer[at : at + n]
            at += n


def _open(uri: str, mode: str):
    """A file in the shared folder: local paths directly, other stores through pyarrow."""
    path = local_path(uri)
    if path is not None:
        return open(path, mode)
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return store.open_output_stream(path) if "w" in mode else store.open_input_file(path)


def _publish(uri: str, to: str) -> None:
    path = local_path(uri)
    if path is not None:
        os.replace(path, local_path(to))
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.move(path, fs.FileSystem.from_uri(to)[1])


# ---- encoding -----------------------------------------------------------------------------

_tables: dict[str, WordTable] = {}
_MARKS = ".,;:!?"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _parts(word: str) -> tuple[str, str]:
    """A word and the punctuation after it, both encoded as if together.

    Letters and digits before a run of punctuation are always tokens of their own. Words of letters
    are lower-cased, as the tokenizer does; final sigma has rules of its own and is left alone.
    """
    core = word.rstrip(_MARKS)
    end = word[len(core) :]
    if end and not (core and core[-1].isalnum() and core[-1].lower().isalnum()):
        core, end = word, ""
    low = core.lower() if core.isalpha() and "Σ" not in core else core
    return (core if low == core else low), end


class _Known:
    """Texts and their ids in Arrow and numpy, some 40 bytes for a word.

    No hash table is kept: what is looked for is hashed, and the known texts are run past it.
    """

    def __init__(self):
        self.texts = pa.chunked_array([], pa.string())
        self.borders, self.ids = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    @property
    def nbytes(self) -> int:
        return self.texts.nbytes + self.borders.nbytes + self.ids.nbytes

    def find(self, texts: pa.Array) -> np.ndarray:
        """The place of each of these different texts, -1 if not known."""
        out, first = np.full(len(texts), -1, np.int64), 0
        for chunk in self.texts.chunks:
            at = pc.fill_null(pc.index_in(chunk, value_set=texts), -1).to_numpy()
            hit = np.flatnonzero(at >= 0)
            out[at[hit]] = first + hit
            first += len(chunk)
        return out

    def add(self, texts: pa.Array, lengths: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The places of texts that were not known."""
        first, chunks = len(self.texts), self.texts.chunks
        # a chunk is joined to those no larger than twice its size, so there are few
        while chunks and len(chunks[-1]) <= 2 * len(texts):
            texts = pa.concat_arrays([chunks.pop(), texts])
        self.texts = pa.chunked_array([*chunks, texts], pa.string())
        self.borders = np.concatenate([self.borders, self.borders[-1] + np.cumsum(lengths)])
        self.ids = np.concatenate([self.ids, ids])
        return np.arange(first, len(self.texts))

    def lengths(self, places: np.ndarray) -> np.ndarray:
        return self.borders[places + 1] - self.borders[places]

    def take(self, places: np.ndarray) -> np.ndarray:
        """The ids of the texts at these places, one after another."""
        each = self.lengths(places)
        ends = np.cumsum(each)
        pick = np.arange(ends[-1] if len(ends) else 0)
        pick += np.repeat(self.borders[places] - ends + each, each)
        return self.ids[pick]


class WordTable:
    """The ids of the words met so far, and of their parts; emptied when it holds CACHE bytes.

    A table lives as long as its worker, next to the tasks of other stages, and its size does not
    follow the input: a corpus has ever more rare words.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        self.words, self.parts = _Known(), _Known()

    def _encode(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids, and the ids, of parts. Those of letters alone are one word each to the tokenizer, so many go in one text."""
        known: dict[str, bytes] = {}
        plain = [x for x in parts if x.isalpha() and x.isascii() or x.isalpha() and unicodedata.is_normalized("NFC", x) and x.lower().isalpha()]
        groups = [plain[i : i + 64] for i in range(0, len(plain), 64)]
        for at in range(0, len(groups), 256):
            some = groups[at : at + 256]
            for group, found in zip(some, self.encoder.encode_batch([" ".join(x) for x in some], add_special_tokens=False), strict=True):
                ids, of = np.array(found.ids, np.uint32).tobytes(), np.array(found.word_ids, np.int64)
                ends = (4 * np.cumsum(np.bincount(of))).tolist() if len(of) else []
                if len(ends) == len(group):
                    known.update(zip(group, (ids[a:b] for a, b in zip([0, *ends], ends)), strict=True))
        rest = [x for x in parts if x not in known]
        for at in range(0, len(rest), 1 << 14):
            some = rest[at : at + (1 << 14)]
            for part, found in zip(some, self.encoder.encode_batch_fast(some, add_special_tokens=False), strict=True):
                known[part] = array("I", found.ids).tobytes()
        made = [known[x] for x in parts]
        return np.fromiter(map(len, made), np.int64, len(made)) // 4, np.frombuffer(b"".join(made), np.uint32)

    def codes(self, words: pa.Array | list[str]) -> np.ndarray:
        """The place in `words`, which holds its ids, of each of these different words."""
        words = words.cast(pa.string()) if isinstance(words, pa.Array) else pa.array(words, pa.string())
        if self.words.nbytes + self.parts.nbytes > CACHE:
            self.clear()
        out = self.words.find(words)
        missing = np.flatnonzero(out < 0)
        if len(missing):
            gc.disable()  # many small lists, no cycles
            new = words.take(pa.array(missing))
            pairs = pa.array([x for word in new.to_pylist() for x in _parts(word)], pa.string()).dictionary_encode()
            places = self.parts.find(pairs.dictionary)
            unmet = np.flatnonzero(places < 0)
            if len(unmet):
                parts = pairs.dictionary.take(pa.array(unmet))
                places[unmet] = self.parts.add(parts, *self._encode(parts.to_pylist()))
            places = places[pairs.indices.to_numpy()]
            out[missing] = self.words.add(new, self.parts.lengths(places).reshape(-1, 2).sum(axis=1), self.parts.take(places))
            gc.enable()
        return out


def encode_texts(texts: pa.Array, path: str, end: int = END) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts, each with the end id after it, and the number of ids of each text."""
    if path not in _tables:
        _tables[path] = WordTable(path)
    table = _tables[path]
    plain = pc.replace_substring(pc.fill_null(texts, ""), "\n", " ")
    if isinstance(plain, pa.ChunkedArray):
        plain = plain.combine_chunks()
    split = pc.split_pattern(plain, " ")
    borders = split.offsets.to_numpy()
    coded = split.values.slice(borders[0], borders[-1] - borders[0]).dictionary_encode()
    codes = table.codes(coded.dictionary)[coded.indices.to_numpy()]
    total = np.concatenate([[0], np.cumsum(table.words.lengths(codes))])
    n = np.diff(total[borders[1:] - borders[0]], prepend=0) + 1
    # every text's end id moves the ids after it on by one
    ids = np.full(int(n.sum()), end, np.uint32)
    spot = np.ones(len(ids), bool)
    spot[np.cumsum(n) - 1] = False
    ids[spot] = table.words.take(codes)
    return ids, n


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about SLICE_BYTES of text, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy()
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if total and total + size > SLICE_BYTES:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    if start < batch.num_rows:
        yield batch.slice(start)


# ---- tables -------------------------------------------------------------------------------


def write_tokens(docs: DataFrame, folder: str, tokenizer: str = TOKENIZER, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode ``docs`` into shards under ``folder``; (shard, path, n_docs, n_ids, n_bytes) per shard."""
    path, run = tokenizer_path(tokenizer), uuid.uuid4().hex[:8]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    order = ["doc_id", F.xxhash64("text"), "text"]
    dealt = rows.repartitionByRange(*order[:2]).sortWithinPartitions(*order)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        shard = task.partitionId()
        final = f"{folder}/shard-{shard:06d}.bitplanes"
        trial = f"{final}.{run}-{task.taskAttemptId()}"
        out, writer = None, None
        for batch in batches:
            for part in _slices(batch, 1):
                if writer is None:
                    if local := local_path(folder):
                        os.makedirs(local, exist_ok=True)
                    out = _open(trial, "wb")
                    writer = ShardWriter(out)
                ids, n = encode_texts(part.column(1), path, end)
                writer.add(part.column(0).to_pylist(), n.tolist(), ids)
        if writer is not None:
            writer.close()
            out.close()
            _publish(trial, final)
            n_bytes = writer.at
            pa.default_memory_pool().release_unused()  # the worker goes on with tasks of other stages
            yield pa.RecordBatch.from_pylist(
                [{"shard": shard, "path": final, "n_docs": len(writer.docs), "n_ids": sum(writer.lengths), "n_bytes": n_bytes}],
                pa.schema([("shard", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64())]),
            )

    return saved(dealt.mapInArrow(write, "shard long, path string, n_docs long, n_ids long, n_bytes long"), "shards")


def read_tokens(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files of ``shards``, one row per document."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    placed = shards.withColumn("first", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    placed = saved(placed.select("path", "first"), "starts")
    spread = placed.repartition(max(1, placed.count()))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with _open(path, "rb") as source:
                    reader, at, out = ShardReader(source), first, []
                    for doc, ids in reader.documents():
                        out.append((doc, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        at += len(ids)
                        if len(out) == 10_000:
                            yield _rows(out)
                            out = []
                    if out:
                        yield _rows(out)

    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    return pa.record_batch([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=names)


def token_table(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Write the shards (by default to the shared folder) and read the table of documents back."""
    return read_tokens(write_tokens(docs, folder or new_folder(docs.sparkSession, "tokens")))
