import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from panelspark.llm import suffixes


def brute(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(b[i : i + length] for b in texts for i in range(len(b) - length + 1))
    out = []
    for (i, _), b in zip(rows, texts):
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_order_is_that_of_sorted_suffixes():
    rnd = random.Random(4)
    for _ in range(40):
        texts = [bytes(rnd.choice(b"ab\x00") for _ in range(rnd.randint(1, 14))) for _ in range(rnd.randint(1, 7))]
        joined, ends = b"".join(texts), np.cumsum([len(t) for t in texts])
        got = [joined[a : ends[np.searchsorted(ends, a, side="right")]] for a in suffixes.suffix_order(texts)]
        assert got == sorted(t[i:] for t in texts for i in range(len(t)))


@pytest.mark.parametrize("most", [20_000, 1])
def test_same_as_all_windows(table, odd, most):
    rnd = random.Random(9)
    passages = ["".join(rnd.choice("abc déf\n") for _ in range(rnd.randint(150, 420))) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = ["".join(rnd.choice("xyz ") for _ in range(rnd.randint(0, 150))), rnd.choice(passages)]
        rows.append((100 + i, "".join(parts * rnd.randint(1, 2))[: rnd.choice([250, 2000])]))
    rows += [*odd, (200, "ab" * 300), (201, "q" * 199), (202, "q" * 200), (203, "r" * 201), (204, rows[0][1]), (204, rows[1][1])]
    got = suffixes.remove_repeats(table(rows), most=most).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, suffixes.LENGTH)


def test_sections_do_not_show(monkeypatch):
    data = bytes(random.Random(2).choice(b"abcd") for _ in range(5000))
    whole = [x for part in suffixes.segments(data) for x in zip(*(c.tolist() for c in part))]
    monkeypatch.setattr(suffixes, "SECTION", 700)
    parts = [x for part in suffixes.segments(data) for x in zip(*(c.tolist() for c in part))]
    windows = [{(name, s) for name, a, b in segs for s in range(a, b - suffixes.LENGTH + 1)} for segs in (whole, parts)]
    assert windows[0] == windows[1] and len(windows[0]) == 5000 - suffixes.LENGTH + 1


def test_empty_table(table):
    assert suffixes.remove_repeats(table([])).collect() == []
