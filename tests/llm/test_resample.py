"""Importance resampling on hashed features."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from panelspark.llm import resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def features(text, most=1):
    words = WORD.findall((text or "").translate(LOWER))
    return words, [" ".join(words[i : i + n]) for n in range(1, most + 1) for i in range(len(words) - n + 1)]


def brute(rows, target, percent=10, least=20, seed=2024, most=1):
    """By the words of the contract."""
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s = Counter(bucket(f) for _, t in rows for f in features(t, most)[1])
    t = Counter(bucket(f) for x in target for f in features(x, most)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    out = []
    for i, text in rows:
        words, found = features(text, most)
        gains = [math.floor(1000 * math.log((t[b] + 1) * (s_all + 10_000) / ((s[b] + 1) * (t_all + 10_000)))) for b in map(bucket, found)]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in out), key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def corpus(n=300):
    return [(i, " ".join(f"w{(i * 7 + k * k) % (5 + i % 90)}" + ("É" if k % 5 == 0 else ",X") for k in range(3 + i % 60))) for i in range(n)]


@pytest.mark.parametrize("most,percent", [(1, 10), (2, 35), (3, 100)])
def test_against_brute_force(spark, table, most, percent):
    rows, target = corpus(), ["w1É w2É X w3", None, "", "w1 W2 w2 w2"]
    goal = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    got = resample.resample(table(rows), goal, percent=percent, max_run=most)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert rows_of(got) == brute(rows, target, percent, most=most)


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab1é🎉 \n.,_\x7f~'"), max_size=80), st.sampled_from([1, 5, 1 << 16]))
def test_offsets_are_those_of_the_words(text, section):
    before, resample.SECTION = resample.SECTION, section
    try:
        assert resample.offsets(text) == [m.span() for m in WORD.finditer(text)]
    finally:
        resample.SECTION = before


def test_odd_rows_and_repeated_ones(spark, table, odd):
    goal = spark.createDataFrame([(1, "word word another")], "item_id long, text string")
    rows = [*odd, *[(6, "word " * 30_000)] * 3, *[(50, "one two " * 20)] * 40, *[(i, "word two " * 20) for i in range(60, 70)]]
    got = rows_of(resample.resample(table(rows), goal, percent=50))
    assert got == brute(rows, ["word word another"], 50)
    ranks = sorted(r[4] for r in got if r[4])
    assert ranks == list(range(1, len(ranks) + 1)) and len(ranks) == 54 // 2
    assert resample.resample(table([]), goal).collect() == []
    empty = goal.filter("false")
    assert rows_of(resample.resample(table(rows), empty, percent=50)) == brute(rows, [], 50)


def test_the_draw_favours_what_looks_like_the_target(spark, table):
    rows = [(i, ("cat dog bird " if i % 4 else "sun moon star ") * 10 + f"x{i}") for i in range(800)]
    goal = spark.createDataFrame([(1, "sun moon star " * 5)], "item_id long, text string")
    got = resample.resample(table(rows), goal, percent=20).filter("rank IS NOT NULL").collect()
    assert len(got) == 160 and sum(r.doc_id % 4 == 0 for r in got) > 120
