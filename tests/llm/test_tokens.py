import gc
import io
import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from panelspark.llm import tokens

PATH = tokens.tokenizer_path(tokens.TOKENIZER)


@pytest.fixture(scope="module")
def plain():
    encoder = Tokenizer.from_file(PATH)
    return lambda text: [*encoder.encode(text or "", add_special_tokens=False).ids, tokens.END]


def test_ids_are_those_of_whole_texts(plain):
    rnd = random.Random(5)
    odd = ["", None, " ", "\n\n", "don't I'll 's's", "İstanbul. ΣΑΣ ΟΔΟΣ.", "foo). (bar... ..x..", "12.5,3 a\tb\x0bc", "é é ́x", "a" * 3000, "<|endoftext|>x", "H̱. Ḵ!"]
    odd += ["".join(rnd.choice("aBcÉé'’s.,;:! \n\t ́ΣσςİıẞßﬁK1½-_()") for _ in range(rnd.randint(1, 30))) for _ in range(1500)]
    ids, n = tokens.encode_texts(pa.array(odd, pa.string()), PATH)
    parts = np.split(ids, np.cumsum(n)[:-1])
    assert [p.tolist() for p in parts] == [plain(t) for t in odd]


@pytest.mark.parametrize("top", [1, 2, 300, 49_408, 2**32])
def test_blocks_come_back(top):
    ids = np.random.default_rng(1).integers(0, top, 1001, dtype=np.uint64).astype(np.uint32)
    planes = tokens.pack_block(ids)
    assert len(planes) == int(ids.max()).bit_length() and (tokens.unpack_block(planes, len(ids)) == ids).all()


def test_shard_reads_single_blocks_and_notices_a_cut():
    ids, out = np.arange(1000, dtype=np.uint32), io.BytesIO()
    writer = tokens.ShardWriter(out, block=64)
    writer.add([7, None], [10, 0], ids[:10])
    writer.add([8], [990], ids[10:])
    writer.close()
    reader = tokens.ShardReader(io.BytesIO(out.getvalue()))
    assert len(reader.blocks) == 16 and (reader.block(3) == ids[192:256]).all()
    assert [(d, x.tolist()) for d, x in reader.documents()] == [(7, list(range(10))), (None, []), (8, list(range(10, 1000)))]
    with pytest.raises(ValueError):
        tokens.ShardReader(io.BytesIO(out.getvalue()[:-5]))


def test_table_from_files(table, odd, plain):
    rows = [*odd, (10, "Some text here."), (9, "and more, of it")]
    got = sorted(tokens.token_table(table(rows)).collect(), key=lambda r: r.start)
    want = [plain(t) for _, t in rows]
    assert sum(r.n_tokens for r in got) == sum(map(len, want))
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))
    crcs = sorted((-1 if i is None else i, len(w), zlib.crc32(np.array(w, "<u4").tobytes())) for (i, _), w in zip(rows, want))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == crcs
    assert tokens.token_table(table([])).collect() == []


def test_a_known_word_takes_little_memory():
    """The table stays in a worker while tasks of other stages run there."""
    rnd = random.Random(8)
    words = list({"".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(40_000)})
    tracemalloc.start()
    table = tokens.WordTable(PATH)
    before = tracemalloc.get_traced_memory()[0]
    codes = table.codes(words)
    taken = tracemalloc.get_traced_memory()[0] - before
    tracemalloc.stop()
    assert codes.tolist() == list(range(len(words)))
    assert taken < 270 * len(words), taken / len(words)


def held(table, batches):
    """Bytes that a table keeps after these words, in Python, numpy and Arrow."""
    gc.collect()
    tracemalloc.start()
    before = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes()
    for words in batches:
        table.codes(words)
    gc.collect()
    taken = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - before
    tracemalloc.stop()
    return taken


def random_words(n, length, seed):
    rnd = random.Random(seed)
    return list({"".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=length)) for _ in range(n)})


def test_a_known_word_takes_tens_of_bytes():
    """Corpora have ever more rare words, and a worker has room for little beside its task's rows."""
    words = random_words(40_000, 9, 9)
    words = [w.title() if i % 3 == 0 else w + ",." if i % 3 == 1 else w for i, w in enumerate(words)]
    assert held(tokens.WordTable(PATH), [words]) < 100 * len(words)


def test_known_words_are_bounded_in_bytes(monkeypatch, plain):
    monkeypatch.setattr(tokens, "CACHE", 200_000)
    table = tokens.WordTable(PATH)
    batches = [random_words(300, 300, seed) for seed in range(20)]
    assert held(table, batches) < 1_500_000
    monkeypatch.setitem(tokens._tables, PATH, table)
    for words in (batches[0], batches[19], batches[19] + ["New", "new.", "new"]):
        ids, n = tokens.encode_texts(pa.array([" ".join(words), None, words[0]]), PATH)
        assert ids.tolist() == [*plain(" ".join(words)), *plain(None), *plain(words[0])] and n.sum() == len(ids)
