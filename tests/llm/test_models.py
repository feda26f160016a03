"""Language ID, quality, personal data and nearest neighbours."""

import random
import re
import time

import numpy as np
import pytest

from panelspark.llm import cotrain, language, neighbours, personal

SYLLABLES = {"aa": ["ka", "lo", "mi", "ta"], "bb": ["sch", "ung", "eit", "zu"], "cc": ["ión", "ñe", "ar", "do"]}


def prose(rnd, lang, n=60):
    return " ".join("".join(rnd.choice(SYLLABLES[lang]) for _ in range(rnd.randint(1, 4))) for _ in range(n)).capitalize() + "."


def test_language_of_unseen_texts(table, odd):
    rnd = random.Random(1)
    rows = [(i, prose(rnd, lang), lang) for i, lang in enumerate(["aa", "bb", "cc", "aa"] * 40)]
    docs = table([*rows, *[(i, t, None) for i, t in odd]])
    model = language.train(docs, ~language.is_held_out())
    got = language.identify(docs, model).collect()
    assert len(got) == len(rows) + len(odd)
    truth = {i: lang for i, _, lang in rows}
    sure = [r for r in got[: len(rows)]]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in sure]) > 0.99
    assert not any(r.rejected for r in sure) and all(0 <= r.score <= 1 for r in got)
    for text in (None, "", " \n", "12 34!"):
        assert model.predict(text) == ("und", 0.0, True)
    assert model.predict("привет как дела")[2]
    kept = language.language_stage(docs)
    assert kept.columns == docs.columns and {i for i, *_ in rows} <= {r.doc_id for r in kept.collect()}


def test_language_without_labels(table, odd):
    docs = table([(i, t, None) for i, t in odd])
    assert {r.lang_pred for r in language.identify(docs, language.train(docs)).collect()} == {"und"}
    assert language.identify(table([]), language.train(docs)).collect() == []


def test_long_texts_are_read_to_the_end(monkeypatch):
    monkeypatch.setattr(language, "STEP", 50)
    rnd = random.Random(2)
    model = language._train([prose(rnd, x) for x in ("aa", "bb") * 30], ["aa", "bb"] * 30)
    assert model.predict(prose(rnd, "aa", 20) + prose(rnd, "bb", 300))[0] == "bb"


def test_quality_by_two_views(spark, table, odd):
    rnd = random.Random(3)
    rows, labels = [], []
    for i in range(300):
        good = i % 3 > 0
        text = prose(rnd, "aa", 40) if good else " ".join(w.upper() + "!!" for w in prose(rnd, "aa", 10).split() * 4)
        rows.append((i, text, "en", f"s{i % 5}"))
        labels.append((i, int(good)))
    docs = table([*rows, *[(None if i is None else 1000 + i, t) for i, t in odd]])
    some = spark.createDataFrame([x for x in labels if x[0] % 2] + [(None, 1), (5, None)], "doc_id long, quality int")
    got = cotrain.score_quality(docs, some).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 for r in got)
    truth = dict(labels)
    assert np.mean([r.kept == bool(truth[r.doc_id]) for r in got if r.doc_id in truth]) > 0.98
    none = some.filter("false")
    assert {r.score for r in cotrain.score_quality(docs, none).collect()} == {0.5}
    assert cotrain.score_quality(table([]), some).collect() == []


def test_pool_rows_teach(monkeypatch):
    """What one view is sure of reaches the other: words that no labelled text holds get a weight."""
    rnd = random.Random(4)
    labelled = [(("good " if i % 2 else "bad!! ") * 20, f"g{i % 2}", "en", 100, i % 2) for i in range(80)]
    pool = [((f"fresh{rnd.randint(0, 9)} " if i % 2 else f"stale{rnd.randint(0, 9)} ") * 20, f"g{i % 2}", "en", 100, None) for i in range(400)]
    with_pool, without = cotrain.fit(labelled, pool), cotrain.fit(labelled, [])
    test = [["fresh1 fresh2 " * 10, "stale1 stale2 " * 10], [None, None], ["en", "en"], [100, 100]]

    def gap(model):
        dense, sparse = cotrain.text_features(test[0])
        z = dense @ model.text[: dense.shape[1]] + np.array([model.text[dense.shape[1] + b] @ w for b, w in sparse])
        return z[0] - z[1]

    assert gap(with_pool) > gap(without) + 0.5


def test_picks_of_parts_hold_the_picks_of_all():
    rng = np.random.default_rng(12)
    keys, p = rng.integers(0, 300, 1_000), rng.random((2, 1_000))
    p[:, 500:] = p[:, :500]
    keys[500:] = keys[:500]  # copies have equal keys and strengths

    def picked(parts):
        found = {}
        for part in parts:
            picks = cotrain.Picks(20, 0.6)
            for at in range(0, len(part), 64):
                some = part[at : at + 64]
                picks.add(keys[some], [p[0][some], p[1][some]], lambda i: None)
            for view, label, key, strength, _ in picks.rows():
                found.setdefault((view, label), {})[key] = strength
        return {g: sorted(rows.items(), key=lambda x: (-x[1], x[0]))[:20] for g, rows in found.items()}

    ids = np.unique(keys, return_index=True)[1]  # one strength per key, as equal rows have
    whole = np.concatenate([ids, ids + 0])
    assert picked([whole]) == picked(np.array_split(rng.permutation(whole), 7)) and len(picked([whole])[(0, 1.0)]) == 20


def test_rare_rows_of_a_large_table_teach(spark, table):
    """Confident rows are found wherever they stand among the unlabelled ones."""
    rnd = random.Random(14)
    labelled = [(i, ("good " if i % 2 else "bad!! ") * 20, "en", f"g{i % 2}") for i in range(80)]
    dull = [(100 + i, f"plain{i % 50} words " * 10, "en", "other") for i in range(3_000)]
    rare = [(9_000 + i, (f"fresh{rnd.randint(0, 9)} " if i % 2 else f"stale{rnd.randint(0, 9)} ") * 20, "en", f"g{i % 2}") for i in range(120)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, quality int")
    test = [["fresh1 fresh2 " * 10, "stale1 stale2 " * 10], [None, None], ["en", "en"], [100, 100]]
    dense, sparse = cotrain.text_features(test[0])

    def gap(model):
        z = dense @ model.text[: dense.shape[1]] + np.array([model.text[dense.shape[1] + b] @ w for b, w in sparse])
        return z[0] - z[1]

    with_rare = gap(cotrain.train(table([*labelled, *dull, *rare]).repartition(9), labels))
    without = gap(cotrain.train(table([*labelled, *dull]).repartition(9), labels))
    assert with_rare > without + 0.5


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def test_base_rules():
    rnd = random.Random(5)
    for _ in range(4000):
        text = "".join(rnd.choice("ab1.@-_ +@.é") for _ in range(rnd.randint(0, 25)))
        assert [(0, m.start(), m.end()) for m in EMAIL.finditer(text)] == [s for s in personal.base_spans(text) if s[0] == 0]
    text = "é x@y.zz 10.0.0.1 256.1.1.1 y 4111 1111 1111 1111 x 4111-1111-1111-1112 +1 (408) 555-7800 +12"
    assert personal.span_text(personal.base_spans(text)) == "email:2:8,ip:9:17,card:30:49,phone:72:89"
    assert personal.base_spans(None) == personal.base_spans("") == []
    assert personal.base_spans("a" * 200_000 + "@") == []


RULES = (
    (1, r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    (2, r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= sum(c.isdigit() for c in m) <= 19 and plain_luhn([int(c) for c in m if c.isdigit()])),
    (3, r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= sum(c.isdigit() for c in m) <= 15),
)


def plain_luhn(digits):
    doubled = [d if k % 2 == 0 else (2 * d if d < 5 else 2 * d - 9) for k, d in enumerate(digits[::-1])]
    return sum(doubled) % 10 == 0


def test_numbers_follow_the_contracts_expressions():
    rnd = random.Random(8)
    pieces = ["4111 1111 1111 1111", "1.2.3.4", "+1 (408) 555-7800", "256.0.0.1", "5500-0000-0000-0004", "12", ".", " ", "-", "+", "7", "x", "é"]
    for _ in range(6000):
        text = "".join(rnd.choice(pieces) if rnd.random() < 0.5 else rnd.choice("0123456789. +-()") for _ in range(rnd.randint(0, 20)))
        want = sorted((kind, m.start(), m.end()) for kind, rule, fine in RULES for m in re.finditer(rule, text) if fine(m[0]))
        assert [s for s in sorted(personal.base_spans(text)) if s[0]] == want, text


def test_long_runs_of_digits_end_in_time():
    start = time.time()
    for text in ("7" * 1_000_000, "+" + "7 " * 500_000, "7-" * 500_000):
        assert personal.base_spans(text) == []
    assert len(personal.base_spans("7." * 500_000)) == 125_000
    assert time.time() - start < 20


def test_gradients():
    tagger = personal.new_tagger()
    tagger.w = {k: v.astype(float) for k, v in tagger.w.items()}
    rng = np.random.default_rng(0)
    ids, tags = rng.integers(0, personal.SYMBOLS, (2, personal.WIDTH)), rng.integers(0, personal.TAGS, (2, personal.WIDTH))
    _, grads = tagger.gradients(ids, tags)
    for name, w in tagger.w.items():
        at = (int(ids[0, 3]), 2) if name == "table" else tuple(int(rng.integers(s)) for s in w.shape)
        ends = []
        for step in (1e-5, -2e-5):
            w[at] += step
            ends.append(tagger.gradients(ids, tags)[0])
        w[at] += 1e-5
        assert grads[name][at] == pytest.approx((ends[0] - ends[1]) / 2e-5, rel=1e-3, abs=1e-6)


@pytest.fixture(scope="module")
def people():
    rnd = random.Random(6)

    def card():
        body = "4" + "".join(rnd.choice("0123456789") for _ in range(14))
        return next(body + d for d in "0123456789" if personal.luhn(body + d))

    def some(kind):
        return [f"{rnd.choice('abcd')}nn.{rnd.randint(1, 99)}@mail{rnd.randint(1, 9)}.example.com", ".".join(str(rnd.randint(0, 255)) for _ in range(4)), card(), f"+1 ({rnd.randint(200, 999)}) 555-{rnd.randint(1000, 9999)}"][kind]

    rows = []
    for i in range(500):
        words = prose(rnd, "aa", 30).split()
        if i % 2:
            words.insert(rnd.randint(2, 20), some(i // 2 % 4))
        else:
            words.insert(rnd.randint(2, 20), rnd.choice(["1999", "id=22ff0562b04fb24acb", "12345", "3.14"]))
        rows.append((i, " ".join(words)))
    return rows


def test_network_adds_and_never_takes(table, people, odd):
    docs = table([*people, *[(None if i is None else 1000 + i, t) for i, t in odd]])
    tagger = personal.train(docs)
    assert max(tagger.thresholds) <= 1
    got = personal.find_personal(docs, tagger).collect()
    for r in got:
        if r.doc_id is not None and r.doc_id < 1000:
            base = personal.base_spans(people[r.doc_id][1])
            assert set(personal.span_text(base).split(",")) <= set(r.spans.split(","))
            assert r.n_email == sum(s[0] == 0 for s in base)
            assert r.doc_id % 2 or r.spans == ""
    # held-out values in held-out text of the language trained on: each kind is found where it stands, and little else
    rng, rnd = np.random.default_rng(21), random.Random(22)
    values = {0: "kim.77@mail3.example.com", 1: "10.20.30.40", 2: "4111111111111111", 3: "+1 (408) 555-7800"}
    texts, truth = [], []
    for n in range(240):
        kind, words = n % 4, prose(rnd, "aa", 40).split()
        value = personal.fresh(kind, values[kind], ["kalo", "mitaka", "talo", "kami"], rng)
        hidden, _ = personal.rewritten(value, [(kind, 0, len(value))], rng)
        before = " ".join(words[: rnd.randint(0, 39)])
        texts.append(f"{before} {hidden} {words[-1]}".strip())
        truth.append((kind, texts[-1].index(hidden), texts[-1].index(hidden) + len(hidden)))
    found = personal.added_spans(texts, [[] for _ in texts], tagger)
    for kind in values:
        own = [(t, f) for t, f in zip(truth, found) if t[0] == kind]
        assert np.mean([t in f for t, f in own]) >= 0.9, personal.KINDS[kind]
    wrong = sum(x != t for t, f in zip(truth, found) for x in f)
    assert wrong <= 0.03 * sum(map(len, found))
    # the operator itself reports them
    rows = personal.find_personal(table([(i, t) for i, t in enumerate(texts)]), tagger).collect()
    assert sum(r.n_added for r in rows) > 200
    assert personal.find_personal(table([]), tagger).collect() == []


def test_blocks_of_windows_find_the_same(monkeypatch, people):
    """Spans in a long text, over block borders too, and longer than a window."""

    class Marks:
        """Tags runs of @ as e-mail: a stand-in for the network that only sees its window."""

        thresholds = [0.5] * 4

        def decode(self, ids):
            at = ids == ord("@")
            tags = np.where(at, 2, 0)
            tags[:, 1:][at[:, 1:] & ~at[:, :-1]] = 1
            tags[:, 0][at[:, 0]] = 2
            return tags, np.ones(ids.shape)

    monkeypatch.setattr(personal, "acceptable", lambda *_: True)
    rnd = random.Random(9)
    text = "".join(" " * rnd.randint(1, 60) + "@" * rnd.randint(1, 300) for _ in range(200)) + " "
    want = [(0, m.start(), m.end()) for m in re.finditer("@+", text)]
    for block in (7, 64, 5_000):
        monkeypatch.setattr(personal, "BLOCK", block)
        assert sorted(personal.added_spans([text, "x", text], [[], [], []], Marks())[2]) == want


def test_windows_hold_every_anchor():
    rnd = random.Random(7)
    for _ in range(200):
        text = "".join(rnd.choice("abc  1@") if rnd.random() < 0.05 else "x" for _ in range(rnd.randint(1, 700)))
        starts = personal.window_starts(text)
        assert starts == sorted(set(starts))
        for m in personal.ANCHOR.finditer(text):
            for a in range(max(0, m.start() - 40), m.start() + 1):  # a span of 41 characters around it
                b = min(len(text), a + 41)
                assert any(s <= a and b <= s + personal.WIDTH and (a > s or s == 0) and (b < s + personal.WIDTH or s + personal.WIDTH >= len(text)) for s in starts)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "'x' AS leaf", "'y' AS v", "1 AS bin")


def exact(rows, k):
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        score = np.einsum("d,rd->r", x[i], x)
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [int(ids[j]) for j in order]
    return out


def test_neighbours_with_ties_and_bad_vectors(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LEAF", 16)
    monkeypatch.setattr(neighbours, "BIN", 30)
    rng = np.random.default_rng(1)
    rows = [(i, [float(np.float32(v)) for v in rng.normal(size=8)], 0) for i in range(600)]
    rows += [(600 + i, rows[3][1], 0) for i in range(150)]  # one very common vector
    bad = [(None, rows[0][1], 0), (1000, None, 0), (1020, [0.0] * 8, 0), (1040, [float("nan")] + [1.0] * 7, 0), (1060, [float("inf")] * 8, 0), (1080, [1.0], 0), (1100, [], 0), (1120, [None] * 8, 0)]
    got = {}
    for r in neighbours.nearest(vectors(spark, rows + bad)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = exact(rows, 20)
    assert set(got) == set(want) and all(len(x) == 20 for x in got.values())
    assert np.mean([len(set(got[q]) & set(want[q])) / 20 for q in want]) >= 0.9


def test_neighbours_of_few(spark):
    rows = [(i, [float(i % 3), 1.0], 0) for i in range(7)]
    got = neighbours.nearest(vectors(spark, rows)).collect()
    assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"])] == exact(rows, 20)[0]
    assert neighbours.nearest(vectors(spark, rows[:1])).collect() == []
    assert neighbours.nearest(vectors(spark, []).filter("true")).collect() == []


def test_copies_and_many_languages_do_not_hide_a_language(table, monkeypatch):
    seen = {}
    monkeypatch.setattr(language, "_train", lambda texts, langs: seen.update(rows=list(zip(langs, texts, strict=True))))
    rnd = random.Random(5)
    words = lambda: " ".join("".join(rnd.choices("abcdefgh", k=6)) for _ in range(20))
    rows = [(i, "one text again and again", "cc") for i in range(600)] + [(1000 + i, words(), x) for x in ("aa", "bb", "cc") for i in range(60)]
    language.train(table(rows), pieces=90)
    assert len(seen["rows"]) == len(set(seen["rows"])) == 90
    assert {x: sum(a == x for a, _ in seen["rows"]) for x in ("aa", "bb", "cc")} == {"aa": 30, "bb": 30, "cc": 30}
    language.train(table([(i, f"text {i}", f"l{i}") for i in range(1100)]), pieces=90)
    assert len({x for x, _ in seen["rows"]}) == 1100


def test_layer_of_many_languages(monkeypatch):
    rnd = random.Random(4)
    texts, langs = [prose(rnd, x) for x in ("aa", "bb") * 30], ["aa", "bb"] * 30
    whole = language._train(texts, langs)
    monkeypatch.setattr(language, "MANY", 1)
    split = language._train(texts, langs)
    assert split.weights.shape[1] == language.DIM and np.allclose(split.logits(texts[0]), whole.logits(texts[0]))
