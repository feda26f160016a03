import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from panelspark.operators import compare
from panelspark.sources import news, prices, results

HEADER = "date,open,high,low,close,adj_close,volume\n"


def test_prices_round_trip(spark, tmp_path):
    (tmp_path / "USDIDR.csv").write_text(HEADER + "2024-01-01,1,2,0.5,1.5,1.5,0\n2024-01-02,1,2,0.5,oops,1.5,0\nbad,1,1,1,1,1,0\n")
    (tmp_path / "USDEUR.csv").write_text(HEADER + "2024-01-01,1,2,0.5,0.9,0.9,3\n")
    bars = prices.read_prices(spark, str(tmp_path))
    assert sorted((r.pair, r.date, r.close) for r in bars.filter("close IS NOT NULL").collect()) == [
        ("USDEUR", dt.date(2024, 1, 1), 0.9), ("USDIDR", dt.date(2024, 1, 1), 1.5)]
    assert bars.count() == 3
    assert prices.read_prices(spark, str(tmp_path), "usdeur").count() == 1
    prices.write_prices(bars, str(tmp_path / "out"))
    back = spark.read.option("header", True).csv(str(tmp_path / "out"))
    assert back.count() == 3 and set(back.columns) == set(bars.columns)


def test_unusable_files_go_to_quarantine(spark, tmp_path):
    (tmp_path / "GOOD.csv").write_text("close,Date\n1.5,2024-01-01\n1.6,2024-01-02 00:00:00\n")
    (tmp_path / "EMPTY.csv").write_text("\n")
    (tmp_path / "HEAD.csv").write_text(HEADER)
    (tmp_path / "NODATE.csv").write_text("open,close\n1,2\n")
    bars, bad = prices.read_prices_checked(spark, str(tmp_path))
    assert sorted((r.pair, r.date, r.close) for r in bars.collect()) == [
        ("GOOD", dt.date(2024, 1, 1), 1.5), ("GOOD", dt.date(2024, 1, 2), 1.6)]
    assert {r.pair: r.reason for r in bad.collect()} == {"EMPTY": "empty", "HEAD": "empty", "NODATE": "no date column"}


def test_quotes_further_columns_and_broken_lines(spark, tmp_path):
    (tmp_path / "A.csv").write_text('Date,"Adj Close",Note,Close\n2024-01-01,1.5,"one, two",9\n"2024-01-02","1,6","say ""hi""",8\n2024-01-03,1.7,"open,7\n')
    (tmp_path / "B.csv").write_text("close,note,datetime\n1,x,2024-01-01 10:00:00\n2,2024-01-02\n3,x,2024-01-03,more\n4,,2024-01-04\n")
    (tmp_path / "C.csv").write_text('Date,"Adj Close",Note,Close\n2024-02-01,2.5,,7\n')
    (tmp_path / "D.csv").write_text('close,date\n"1,2024-01-01\n')
    bars, bad, lines = prices.read_prices_checked(spark, str(tmp_path), broken=True)
    got = sorted((r.pair, r.date.day, r.adj_close, r.close) for r in bars.collect())
    assert got == [("A", 1, 1.5, 9.0), ("A", 2, None, 8.0), ("B", 1, None, 1.0), ("B", 4, None, 4.0), ("C", 1, 2.5, 7.0)]
    assert sorted((r.pair, r.line[0]) for r in lines.collect()) == [("A", "2"), ("B", "2"), ("B", "3"), ("D", '"')]
    assert {r.pair: r.reason for r in bad.collect()} == {"D": "no readable line"}


@pytest.mark.parametrize("day", ["Date", "Datetime", "Index"])
def test_normalise_bars(spark, day):
    df = spark.createDataFrame([("2024-01-02 10:00:00", 1.0, 2.0, "x"), ("nope", 1.0, 2.0, "x")], [day, "Adj Close", "('Open', 'T')", "Extra"])
    out = prices.normalise_bars(df)
    assert out.columns == ["date", "open", "adj_close"] and out.collect()[0].date == dt.date(2024, 1, 2) and out.count() == 1


ARTICLE = {"title": "t", "publisher": "p", "link": "", "published_at": "2024-01-01 10:00:00", "type": "S", "thumbnail": "",
           "related_tickers": [], "summary": "s, \"quoted\""}


def test_news_files(spark, tmp_path):
    (tmp_path / "USDIDR_news.json").write_text(json.dumps([ARTICLE, {**ARTICLE, "title": "u"}], indent=2))
    pairs = spark.createDataFrame([("USDIDR",), ("USDEUR",)], "pair string")
    rows = news.read_news(spark, str(tmp_path), pairs).collect()
    assert sorted((r.pair, r.title) for r in rows if r.title) == [("USDIDR", "t"), ("USDIDR", "u")]
    assert [r.pair for r in rows if not r.title] == ["USDEUR"]
    assert rows[0].published_ts == dt.datetime(2024, 1, 1, 10) or rows[0].title is None
    flat = news.read_news(spark, str(tmp_path)).select("pair", *news.ARTICLE_FIELDS)
    news.write_news_csv(flat, str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv"))
    assert {r.related_tickers for r in back.collect()} == {"[]"} and {r.summary for r in back.collect()} == {ARTICLE["summary"]}
    news.write_news_json(flat, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2


def test_flatten_articles(spark):
    nested = {"id": 1, "content": {"title": "T", "provider": {"displayName": "P"}, "clickThroughUrl": {"url": "L"},
              "pubDate": "2025-12-17T09:50:00.000Z", "thumbnail": {"resolutions": [{"url": "A"}, {"url": "B"}]},
              "finance": {"stockTickers": ["X", "Y"]}, "contentType": "STORY", "summary": "S"}}
    top = {"title": "T2", "provider": "Plain", "url": "U", "pubDate": "yesterday", "thumbnail": "pic", "content": {}}
    df = spark.createDataFrame([(0, json.dumps(nested)), (1, json.dumps(top))], "id int, raw string")
    a, b = news.flatten_articles(df).orderBy("id").collect()
    assert tuple(a)[1:] == ("T", "P", "L", "2025-12-17 09:50:00", "STORY", "A", ["X", "Y"], "S")
    assert tuple(b)[1:] == ("T2", "Plain", "U", "yesterday", "", "pic", [], "")


def test_normalise_results(spark):
    df = spark.createDataFrame([("USDIDR", "5", "arima", "1.5", "bad")], [" Pair", "H", "baseline_model", "RMSE", "Acc "])
    out = results.normalise_results(df)
    r = out.first()
    assert (r.currency, r.horizon, r.model, r.config, r.rmse, r.da) == ("USDIDR", 5, "arima", "default", 1.5, None)
    assert results.normalise_results(df, horizon_as_text=True).first().horizon == "5"
    with pytest.raises(ValueError, match="mape"):
        results.require_columns(out, ["rmse", "mape"])


def test_sinks(spark, data, tmp_path):
    rows = results.read_results(spark, f"{data}/results.csv").withColumn(
        "type", F.when(F.col("config") == "baseline", "baseline").otherwise("llm"))
    results.write_results(compare.per_series_table(rows.withColumn("ord", F.lit(0))), str(tmp_path / "tables"), ["currency"])
    assert spark.read.option("header", True).csv(str(tmp_path / "tables")).count() == 240
    results.write_windows(rows, str(tmp_path / "windows"))
    part = spark.read.parquet(str(tmp_path / "windows")).filter("type = 'llm' AND horizon = 5")
    assert part.count() == 60
    results.write_documents(results.experiment_documents(rows), str(tmp_path / "docs"))
    docs = spark.read.json(str(tmp_path / "docs"))
    assert sorted((r.currency, len(r.baseline_results), len(r.llm_results)) for r in docs.collect())[0] == ("USDAUD", 12, 36)


def test_comparisons_read_a_bucketed_table_without_exchange(spark, tmp_path):
    import random

    from panelspark.operators import significance

    draw, rows = random.Random(4), []
    for currency in ("A", "B", "C"):
        for horizon in (1, 5):
            runs = [("baseline", m, "baseline") for m in ("n", "m")]
            runs += [("llm", m, c) for m in ("x", "y") for c in ("baseline_llm", "news_only", "prompt_only", "full_model")]
            rows += [(t, m, c, currency, horizon, w, draw.random() * 9, draw.random() * 100) for t, m, c in runs for w in range(12)]
    schema = "type string, model string, config string, currency string, horizon int, window int, window_rmse double, window_da double"
    df = spark.createDataFrame(rows, schema)
    results.write_bucketed(df, "window_table", str(tmp_path / "windows"), buckets=4)
    before = {k: spark.conf.get(k, None) for k in (*results.BUCKETED, "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        for k, v in {**results.BUCKETED, "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}.items():
            spark.conf.set(k, v)
        table = spark.table("window_table")
        tests = significance.dm_statistics(significance.dm_losses(table), ["rq", *compare.UNIT])
        plan = tests._jdf.queryExecution().executedPlan().toString()
        exchanged = [x for x in plan.splitlines() if "Exchange" in x]
        # only partial sums of the losses move; nothing reads the window table through an exchange
        assert "Bucketed: true" in plan and len(exchanged) == 1 and "(rq#" in exchanged[0], exchanged
        got = {(r.rq, r.currency, r.horizon, r.model): round(r.mean_d, 9) for r in tests.collect()}
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
        spark.sql("DROP TABLE window_table")
    want = significance.dm_statistics(significance.dm_losses(df), ["rq", *compare.UNIT]).collect()
    assert got == {(r.rq, r.currency, r.horizon, r.model): round(r.mean_d, 9) for r in want} and len(got) == 4 * 6 * 2
