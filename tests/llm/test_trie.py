"""The prefix trie of conversations."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from panelspark.llm import trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows, family=20, shared=4):
    """Every prefix of every conversation in a dictionary."""
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, r or "", hashlib.md5((x or "").encode()).hexdigest(), x or ""))
    own = {c: [(r, x) for _, _, r, _, x in sorted(v)] for c, v in own.items()}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % shared
        paths[c] = own.get(c - c % family, [])[:h] + turns[h:]
    nodes, kids = {}, {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            nodes.setdefault(tuple(path[:d]), []).append(c)
    for p in nodes:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved, out = {}, {}, []
    for p in sorted(nodes, key=len, reverse=True):
        below = kids.get(p, [])
        leaves[p] = sum(leaves[k] for k in below) if below else 1
        saved[p] = sum(saved[k] for k in below) + ((len(nodes[p]) - 1) * len(WORD.findall(p[-1][1])) if p else 0)
        ends = ",".join(str(c) for c in sorted(nodes[p]) if len(paths[c]) == len(p))
        up = min(nodes[p[:-1]]) if p else None
        out.append((min(nodes[p]), len(p), up, len(nodes[p]), len(below), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def built(df, per_part):
    out = trie.conversation_trie(df, per_part=per_part)
    assert tuple(out.columns) == trie.RESULT
    return sorted((tuple(r) for r in out.collect()), key=str)


def scene(seed):
    draw, rows = random.Random(seed), []
    for c in draw.sample(range(300), 100):
        for t in range(draw.choice([1, 1, 2, 3, 5])):
            rows.append((c, draw.choice([t, t, t, None]), draw.choice(["u", "a", None]), draw.choice(["x", "x", "x y", "", None])))
        if c % 7 == 0:
            rows += [(c, 0, "u", "x")] * 2
    rows += [(500 + i, t, "u", "same words") for i in range(80) for t in range(3)]  # a third of all conversations
    rows += [(700 + k, t, "u", f"w {t // 50}") for k in range(2) for t in range(120 + k)]  # long chains
    rows += [(None, 1, "u", "x"), (None, None, None, None)]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,per_part", [(1, 10), (2, 60), (3, 10**6)])
def test_against_brute_force(spark, seed, per_part):
    rows = scene(seed)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({n: F.lit("clash") for n in ("part", "node", "path", "words", "h", "lead", "hash", "depth")})
    assert built(df, per_part) == brute(rows)


def test_one_conversation_many_copies_and_none(spark):
    one = [(7, t, "u", f"a {t}") for t in range(5)]
    assert built(spark.createDataFrame(one, SCHEMA), 2) == brute(one)
    copies = [(i * 20, t, "u", "same") for i in range(2000) for t in range(2)]
    assert built(spark.createDataFrame(copies, SCHEMA), 300) == brute(copies)
    assert built(spark.createDataFrame([], SCHEMA), 10) == []
    assert built(spark.createDataFrame([(None, 1, "u", "x")], SCHEMA), 10) == []


def test_turnless_conversations_are_members_of_the_root(spark):
    # a conversation without own turns after its first h, whose lead is missing, has no turns at all
    short = [c for c in range(1, 200) if c % 20 and zlib.crc32(str(c).encode()) % 4 >= 1][:30]
    rows = [(c, 0, "u", "x") for c in short]
    got = built(spark.createDataFrame(rows, SCHEMA), 5)
    assert got == brute(rows) and len(got) == 1 and got[0][3] == 30 and got[0][5] == 1


def test_long_texts_and_roles_are_told_apart(spark):
    rows = [(20, 0, "a", "b c"), (40, 0, "a b", " c"), (60, 0, "a", "word " * 50_000), (80, 0, None, "")]
    assert built(spark.createDataFrame(rows, SCHEMA), 2) == brute(rows)


def test_unions_make_the_branching_nodes():
    a, b, c, d = (bytes([k]) * trie.HASH for k in range(1, 5))
    paths = [a + b, a + b, a + b + c, a + b + d, a + c, d]
    common = [trie.lcp(x, y) for x, y in zip(paths, paths[1:])]
    assert common == [2, 2, 2, 1, 0]
    depth, first, last, parent = trie.compressed([len(p) // trie.HASH for p in paths], common)
    found = {(d, f, l, parent[v] if parent[v] < 0 else depth[parent[v]]) for v, (d, f, l) in enumerate(zip(depth, first, last)) if parent[v] != -2}
    assert found == {(0, 0, 5, -1), (1, 0, 4, 0), (2, 0, 3, 1), (3, 2, 2, 2), (3, 3, 3, 2), (2, 4, 4, 1), (1, 5, 5, 0)}


def test_lcp_of_long_paths():
    x = bytes(range(256)) * 4
    for k in range(0, 64, 7):
        y = x[: k * 16] + b"\xff" * 16 + x[k * 16 + 16 :]
        assert trie.lcp(x, y) == k == trie.lcp(y, x)
    assert trie.lcp(x, x) == 64 == trie.lcp(x, x + x) and trie.lcp(b"", x) == 0
