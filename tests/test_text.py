import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelspark.functions import extract, text, tokens
from panelspark.operators import context, explain
from panelspark.params import CONNECTORS, FACTOR_TERMS


def one(spark, column, **values):
    df = spark.range(1).select(*[v.alias(k) if hasattr(v, "alias") else F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column.alias("out")).first().out


def array(values):
    return F.array(*[F.lit(float(v)) for v in values])


def test_bins_equal_search(spark):
    edges = np.linspace(-1.0, 1.0, 10_001)
    rng = np.random.default_rng(0)
    v = np.concatenate([rng.uniform(-1.2, 1.2, 5000), edges, edges + 1e-12, edges - 1e-12])
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    got = df.select("v", tokens.bin_index(F.col("v")).alias("k"), tokens.snap(F.col("v")).alias("c")).toPandas()
    k = np.searchsorted(edges[1:-1], np.clip(got["v"].values, -1, 1))
    assert (got["k"].values == k).all()
    assert got["c"].values == pytest.approx(((edges[:-1] + edges[1:]) / 2)[k], abs=1e-12)


def test_encode_units(spark):
    assert one(spark, tokens.encode(array([1, 2, 3]))) == "###-0.5001###  ###-0.0001###  ###0.4999###"
    assert one(spark, tokens.encode(array([4, 4, 4]))) == "  ".join(["###-0.0001###"] * 3)


def test_decode_units(spark):
    h = array([4, 4, 4])
    assert one(spark, tokens.decode(F.lit("###-0.0001###"), h, F.lit(3))) == [4.0, 4.0, 4.0]
    assert one(spark, tokens.decode(F.lit("no idea"), array([1, 2]), F.lit(3))) == [2.0, 2.0, 2.0]
    short = one(spark, tokens.decode(F.lit("x ###0.5### y"), array([1, 3]), F.lit(3)))
    assert short == [3.0, 3.0, 3.0]
    many = one(spark, tokens.decode(F.lit("###0.5### ###-0.5### ###0.0###"), array([1, 3]), F.lit(2)))
    assert many == [3.0, 1.0]
    walk = tokens.random_walk(array([1, 2, 4, 3]), F.lit(4), F.lit("w1"))
    first, again = one(spark, walk), one(spark, walk)
    assert first == again and len(first) == 4 and len(set(first)) == 4


@settings(max_examples=10, deadline=None)
@given(st.lists(st.floats(1, 1e5), min_size=2, max_size=30))
def test_decode_inverts_encode(spark, values):
    v = array(values)
    back = one(spark, tokens.decode(tokens.encode(v), v, F.lit(len(values))))
    width = max(values) - min(values)
    assert back == pytest.approx(values, abs=width * 2.1e-4 + 1e-9)


def test_future_tokens(spark):
    assert one(spark, tokens.encode_future(array([1, 2, 9]), array([1, 3]))) == "###-0.5000###  ###-0.0000###  ###0.5000###"


@pytest.mark.parametrize(
    "response, case, numbers",
    [
        ("1.1, 1.2]}", 1, [1.1, 1.2]),
        ('{"predictions": [1.1]}', 2, [1.1]),
        ("about [1.1, 1.2]", 3, [1.1, 1.2]),
        ("bad [1.1.1, 2] then 3.5", 4, [1.1, 3.5]),
        ("maybe 1.15", 4, [1.15]),
        ("none", None, None),
        ('so {"predictions": oops} but 7.25', 4, [7.25]),
    ],
)
def test_number_extraction(spark, response, case, numbers):
    df = spark.createDataFrame([(response,)], "response string")
    row = extract.with_numbers(df).first()
    assert row.parse_case == case
    if response.startswith("bad"):
        assert row.numbers[-1] == 3.5
    else:
        assert row.numbers == numbers
    good, bad = extract.split_parsed(extract.with_numbers(df))
    assert (good.count(), bad.count()) == ((1, 0) if case else (0, 1))


def test_at_most_twenty_decimals(spark):
    response = "x " + " ".join(f"{i}.5" for i in range(30))
    df = spark.createDataFrame([(response,)], "response string")
    assert len(extract.with_numbers(df).first().numbers) == 20
    assert len(extract.with_numbers(df, max_decimals=None).first().numbers) == 30


def test_space_around_a_response_does_not_count(spark):
    df = spark.createDataFrame([("\u00a0\n 12, 13.5 then 99.5",), ('{"predictions": [1.1, "n/a"]}',)], "response string")
    first, second = extract.with_numbers(df).collect()
    assert first.parse_case == 1 and first.numbers == [12.0, 13.5]
    assert second.parse_case != 2


@pytest.mark.parametrize("fields", [
    '"explanation": "plain words"', '"explanation": null', '"explanation": {"confidence": "high"}', '"explanation": {"confidence": null}',
    '"explanation": {"summary": "s", "risk_factors": "war"}', '"explanation": {"key_factors": ["a", 1]}', '"explanation": {"summary": 3}',
    '"explanation": {"key_factors": null}', '"explanation": {"summary": null}',
])
def test_fields_of_the_wrong_kind_lose_no_text(spark, fields):
    text = '{"predictions": [1.5, 2], ' + fields + "}"
    row = extract.with_explanation(spark.createDataFrame([(f"  {text}\n",)], "response string")).first()
    assert row.explanation_text == text and row.predictions == [1.5, 2.0]
    assert row.confidence_score == 0.5 and row.news_refs == [] and not row.bad_predictions


def test_numbers_in_words_are_read_and_bad_predictions_marked(spark):
    rows = [('{"predictions": [1.1, "n/a"], "explanation": {"summary": "s", "confidence": "0.25"}}',), ('{"predictions": "none"}',), ("{}",)]
    a, b, c = extract.with_explanation(spark.createDataFrame(rows, "response string")).collect()
    assert a.bad_predictions and a.predictions == [] and a.explanation_text == "s" and a.confidence_score == 0.25
    assert b.bad_predictions and not c.bad_predictions


def test_scale_filter(spark):
    keep = extract.in_scale(array([10, 11, 500]), F.lit(10.0))
    assert one(spark, keep) == [10.0, 11.0]
    assert one(spark, extract.in_scale(array([1000, 2000, 500, 9]), F.lit(10.0))) == [1000.0, 2000.0, 500.0, 9.0]
    assert one(spark, extract.in_scale(array([1000]), F.lit(0.0))) == [1000.0]


def test_explanation_fields(spark):
    full = {
        "predictions": [1.5, 2],
        "explanation": {"summary": "Rates rise", "key_factors": ["fed"], "risk_factors": ["war"],
                        "news_references": [1, 3], "confidence": 1.7},
    }
    rows = [(0, "text before " + json.dumps(full, indent=1) + " after"), (1, "no braces 1.5"), (2, "{broken [1.5, 2.5]"),
            (3, "{broken [1.5, 2.5]}"), (4, '{"explanation": {"summary": "s"}}')]
    out = {r.id: r for r in extract.with_explanation(spark.createDataFrame(rows, "id int, response string")).collect()}
    assert out[0].predictions == [1.5, 2.0] and out[0].explanation_text == "Rates rise fed war"
    assert out[0].news_refs == [1, 3] and out[0].confidence_score == 1.0
    assert out[1].predictions == [] and out[1].explanation_text == "" and out[1].confidence_score == 0.5
    assert out[2].explanation_text == ""
    assert out[3].predictions == [1.5, 2.5] and out[3].explanation_text == rows[3][1]
    assert out[4].predictions == [] and out[4].explanation_text == "s" and out[4].news_refs == []


def expected_scores(t):
    low = t.lower()
    cats = [c for c, ks in FACTOR_TERMS.items() if any(k in low for k in ks)]
    n = len(low.split())
    if not t or len(t) < 10:
        return cats, 0.0, n
    score = min(0.3, n / 50 * 0.3) + min(0.4, sum(c in low for c in CONNECTORS) * 0.1)
    score += min(0.3, sum(k in low for ks in FACTOR_TERMS.values() for k in ks) * 0.05)
    return cats, round(score, 3), n


def test_explanation_scores(spark):
    texts = ["", "short", "The Fed offered a rate hike because of inflation and risk", "word " * 80,
             "oil and gold amid tension\n\nunemployment", "Given the TREND, driven by growth, despite war; supported by trade"]
    titles = ["Rate hike looms over markets now oil", "", "Nothing here"]
    df = spark.createDataFrame([(i, t, [1, 9], titles) for i, t in enumerate(texts)],
                               "id int, explanation_text string, news_refs array<int>, titles array<string>")
    for r in explain.with_explanation_scores(df).collect():
        cats, score, n = expected_scores(texts[r.id])
        assert (r.factor_types, r.explanation_len) == (cats, n)
        assert r.coherence_score == pytest.approx(score, abs=1e-9)
        assert r.news_grounding_rate == pytest.approx(1 / 3)
    free = explain.with_explanation_scores(df.withColumn("news_refs", F.array().cast("array<int>"))).collect()
    for r in free:
        low = texts[r.id].lower()
        hit = sum(any(w.lower() in low for w in t.split()[:4]) for t in titles)
        assert r.news_grounding_rate == pytest.approx(hit / 3)


def test_prediction_error(spark):
    rows = [(0, [1.0, 2.0], [1.5, 2.5, 9.0]), (1, [1.0, 2.0], [1.0]), (2, [1.0], [3.0])]
    out = {r.id: r for r in explain.with_prediction_error(
        spark.createDataFrame(rows, "id int, truth array<double>, predictions array<double>")).collect()}
    assert (out[0].abs_pred_error, out[0].directional_accuracy) == (0.5, 100.0)
    assert out[1].abs_pred_error is None and out[2].abs_pred_error == 2.0 and out[2].directional_accuracy is None


def test_labels(spark):
    ps = {None: "n/a", 0.0004: "p<0.001", 0.0312: "p=0.031"}
    for p, want in ps.items():
        assert one(spark, text.p_text(F.lit(p).cast("double"))) == want
    assert one(spark, text.label(F.lit("a"), F.lit("b"))) == "a (b)"
    assert one(spark, text.label(F.lit("a"), F.lit("b"), "colons")) == "a::b"
    assert one(spark, F.concat(text.base_of(F.lit("USDIDR")), text.quote_of(F.lit("USDIDR")))) == "USDIDR"
    assert one(spark, text.shorten(F.lit("x" * 201), 200)) == "x" * 197 + "..."
    assert one(spark, text.shorten(F.lit("x" * 200), 200)) == "x" * 200


def test_news_text_styles_and_leak(spark):
    news = spark.sql("""SELECT 's' series, id article_id, date_add(DATE'2024-01-01', CAST(id AS INT)) published_on,
        concat('title ', id) title, 'pub' publisher, IF(id = 8, '', repeat('y', 160)) summary FROM range(0, 20)""")
    windows = spark.sql("""SELECT 's' series, 1 horizon, w window, d window_day FROM VALUES
        (0, DATE'2024-01-10'), (1, DATE'2023-01-01') AS t(w, d)""")
    found = context.articles_before(windows, news, k=3)
    assert sorted(r.article_id for r in found.collect()) == [6, 7, 8]
    texts = {r.window: r.news_text for r in context.news_text(found, windows, style="cited").collect()}
    assert texts[1] == "No recent news available."
    assert texts[0].split("\n") == ["[1] [2024-01-09] title 8", f"[2] [2024-01-08] title 7 — {'y' * 147}...",
                                    f"[3] [2024-01-07] title 6 — {'y' * 147}..."]
    leaky = context.articles_before(windows, news, k=3, leaky=True)
    assert sorted((r.window, r.article_id) for r in leaky.collect()) == [(w, a) for w in (0, 1) for a in (17, 18, 19)]
    brief = {r.window: r.news_text for r in context.news_text(found, windows, style="brief").collect()}
    assert brief[0].startswith("1. [2024-01-09] title 8\n2. ")


def test_articles_before_equals_a_plain_join(spark):
    news = spark.sql("""SELECT IF(id % 3 = 0, 'hot', 'cold') series, id article_id,
        date_add(DATE'2024-01-01', CAST(pmod(id * 7, 20) AS INT)) published_on FROM range(0, 600)""").cache()
    windows = spark.sql("SELECT s series, 1 horizon, CAST(id AS INT) window, date_add(DATE'2023-12-30', CAST(id AS INT)) window_day "
                        "FROM range(0, 30) CROSS JOIN VALUES ('hot'), ('cold') AS t(s)")
    got = {(r.series, r.window, r["rank"], r.article_id) for r in context.articles_before(windows, news, k=8).collect()}
    arts = [(r.series, r.article_id, r.published_on) for r in news.collect()]
    want = set()
    for w in windows.collect():
        near = [a for a in arts if a[0] == w.series and 0 < (w.window_day - a[2]).days <= 7]
        near.sort(key=lambda a: (-a[2].toordinal(), a[1]))
        want |= {(w.series, w.window, i + 1, a[1]) for i, a in enumerate(near[:8])}
    assert got == want


def test_examples_fit_short_histories(spark):
    df = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(70)), lambda x: x.cast("double")).alias("hist"),
                               F.transform(F.sequence(F.lit(1), F.lit(70)), lambda x: F.date_add(F.lit("2024-01-01").cast("date"), x)).alias("hist_days"))
    a = df.select(context.token_examples(F.col("hist"), F.lit(5)).alias("t"), context.price_examples(F.col("hist"), F.col("hist_days"), F.lit(5)).alias("p"),
                  context.token_examples(F.slice("hist", 1, 34), F.lit(5)).alias("none")).first()
    assert a.t.count("Case ") == 1 and a.none == "No examples available."
    assert a.p.count("Case ") == 1 and "[31.0, 32.0, 33.0, 34.0, 35.0]" in a.p and "2024-01-22: 21.0000" in a.p


def test_retries(spark):
    rows = [("q1", 0, "no"), ("q1", 1, "###0.1###"), ("q1", 2, "###0.2###"), ("q2", 0, "a"), ("q2", 1, "b")]
    df = spark.createDataFrame(rows, "q string, attempt int, response string")
    out = {r.q: (r.attempts, r.valid, r.response) for r in explain.retry_outcomes(df, ["q"]).collect()}
    assert out == {"q1": (3, True, "###0.1###"), "q2": (2, False, "b")}


def test_found_terms_are_the_substrings(spark):
    from hypothesis import given, settings
    from hypothesis import strategies as st

    from panelspark.functions.text import SPACES, found_terms, stripped

    terms = ["war", "warm", "a", "ar", "interest rate", "rate", "é", "aa", "war"]
    parts = st.sampled_from(["w", "a", "r", "m", "rate", "interest ", " ", "\x85", "\u2003", "\x1c", "é", "x", "\n"])
    cases = [None, ""]

    @settings(max_examples=200, deadline=None, database=None)
    @given(st.lists(parts, max_size=12))
    def gather(xs):
        cases.append("".join(xs))

    gather()
    df = spark.createDataFrame(list(enumerate(cases)), "i int, t string")
    for r in df.select("i", found_terms(F.col("t"), terms).alias("f"), stripped(F.col("t")).alias("s")).collect():
        t = cases[r.i]
        if t is None:
            assert r.f is None or (r.f.terms is None and r.f.words is None)
        else:
            assert set(r.f.terms) == {x for x in terms if x in t} and len(r.f.terms) == len(set(r.f.terms))
            assert r.f.words == len(t.split()) and r.s == t.strip() == t.strip(SPACES)


@pytest.mark.parametrize("chunk_seconds", [50, 3_600, 10**9])
def test_articles_asof_to_the_microsecond(spark, chunk_seconds):
    import random

    from panelspark.operators.context import articles_asof

    draw = random.Random(3)
    times = [draw.randrange(0, 4000) for _ in range(400)]
    news = [("hot" if i % 10 else "cold", i, t, "clash") for i, t in enumerate(times)] + [("none", 900, None, "x"), ("hot", 901, 2000, "x")]
    asks = [(s, w, t) for w, t in enumerate([0, 1, 500, 500, 2000, 2001, 3999, 9999, None]) for s in ("hot", "cold", "none", "new")]
    as_time = F.expr("timestamp_micros(t * 1000000 + 7)")
    n = spark.createDataFrame(news, "series string, article_id long, t long, rank string").withColumn("published_ts", as_time).drop("t", "rank")
    w = spark.createDataFrame(asks, "series string, window int, t long").withColumn("window_ts", as_time).drop("t")
    got = {}
    for r in articles_asof(w, n, 5, 300, ("series", "window"), chunk_seconds=chunk_seconds).collect():
        got.setdefault((r.series, r.window), {})[r["rank"]] = r.article_id
    want = {}
    for s, win, t in asks:
        near = sorted((-x, i) for q, i, x, _ in news if q == s and x is not None and t is not None and t - 300 <= x < t)[:5]
        if near:
            want[(s, win)] = {k: i for k, (_, i) in enumerate(near, 1)}
    assert got == want
