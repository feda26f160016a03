import random
import re
import tracemalloc

import numpy as np
import pytest

from panelspark.llm import neardup, shared
from panelspark.llm.components import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + min(k, len(w))]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute(rows, k, percent):
    """Set size and least id of the component of every row, over all pairs."""
    sets = [(i, shingles(t, k)) for i, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (_, s) in enumerate(sets):
        for b in range(a):
            o = sets[b][1]
            if s and o and 100 * len(s & o) >= percent * len(s | o):
                root[max(find(a), find(b))] = min(find(a), find(b))
    out = []
    for a, (i, s) in enumerate(sets):
        group = [sets[b][0] for b in range(len(rows)) if find(b) == find(a)]
        ids = [x for x in group if x is not None]
        least = min(ids) if ids and len(group) > 1 else i
        out.append((i, len(s), least, i == least))
    return sorted(out, key=str)


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_same_as_all_pairs(table, k, percent):
    rnd = random.Random(k)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for _ in range(12):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice([4, 9, 60, 150]))]
        for _ in range(rnd.randint(1, 7)):
            text = [rnd.choice(vocabulary) if rnd.random() < 0.02 else w for w in base]
            rows.append((n, " ".join(text).upper() if rnd.random() < 0.5 else "  ".join(text)))
            n += 1
    got = neardup.near_duplicates(table(rows), k, percent).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, k, percent)


def test_odd_rows_and_empty_table(table, odd):
    got = neardup.near_duplicates(table(odd)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(odd, 3, 85)
    assert neardup.near_duplicates(table([])).collect() == []


def test_hot_group_makes_no_pairs_inside(table):
    """A chain of near copies around many exact ones: linked through others, in one component."""
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(base)) for i in range(300)]
    rows += [(1000 + i, " ".join(base[i : 190 + i] + [f"x{j}" for j in range(i)])) for i in range(9)]
    got = neardup.near_duplicates(table(rows)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, 3, 85)


@pytest.mark.parametrize("similarity", [0.8, 0.85])
def test_near_signatures_share_a_key(similarity):
    rng = np.random.default_rng(1)
    cut, most = neardup.chunks(similarity), neardup.allowed_distance(similarity)
    for _ in range(300):
        a = rng.integers(0, 1 << 16, neardup.HASHES, dtype=np.uint64)
        b = a.copy()
        b[rng.choice(neardup.HASHES, most, replace=False)] ^= np.uint64(1)
        assert set(neardup._keys(a, cut)) & set(neardup._keys(b, cut))


def test_stage_keeps_one_of_each_group(table, odd):
    text = " ".join(f"w{i}" for i in range(50))
    docs = table([*odd, (7, text), (8, text + " end"), (9, "something else entirely")])
    out = neardup.near_duplicate_stage(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id for r in out.collect()), key=str) == [1, 2, 3, 4, 5, 6, 7, 9, None]


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "u long, v long")
    got = dict(components(links).collect())
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}
    assert components(links.filter("false")).collect() == []


def test_stage_tells_rows_of_one_id_apart(table):
    rnd = random.Random(8)
    text = [" ".join(rnd.choices("abcdefghijklmnop", k=30)) for _ in range(6)]
    near = text[0] + " q"
    rows = [(None, text[1]), (None, text[2]), (None, None), (5, text[3]), (5, text[4]), (5, text[4]), (1, text[0]), (2, near), (2, text[5]), (7, ""), (7, None)]
    got = sorted(((r.doc_id, r.text) for r in neardup.near_duplicate_stage(table(rows)).collect()), key=str)
    assert got == sorted(set(rows) - {(2, near), (None, None)}, key=str)


def test_hashing_words_takes_little_memory_and_sections_do_not_change_them(monkeypatch):
    texts = [f"Word{i} " * 6 + "x" * (i % 50) for i in range(40_000)]
    texts += [" ".join(texts[:20_000]), "y" * 700_000 + " z", None]
    tracemalloc.start()
    hashes, counts = shared.batch_word_hashes(texts)
    taken = tracemalloc.get_traced_memory()[1] - hashes.nbytes
    tracemalloc.stop()
    monkeypatch.setattr(shared, "SECTION", 1 << 23)
    whole, same = shared.batch_word_hashes(texts)
    assert (hashes == whole).all() and (counts == same).all()
    assert taken < 40 << 20, taken
