import corpus_pipeline
import __spark_entry__ as entry


def test_queries_are_registered():
    names = set(entry.queries())
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{i}" for i in range(1, 11)}


def test_stages_keep_columns_and_feed_each_other(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != "token_ids":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        rows = out.collect()
        counts.append(len(rows))
        docs = spark.createDataFrame(rows, out.schema)
    assert counts[0] >= counts[1] >= counts[2] >= counts[3] and counts[4] == counts[5] > 0
    assert counts[1] >= counts[0] - 2
    starts = sorted((r.start, r.n_tokens) for r in rows)
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))


def test_stages_on_odd_rows(spark, sf, table, odd):
    docs = table([(i, t, "en") for i, t in odd], extra=False)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() >= 0
        assert stage(spark, docs.filter("false"), sf).count() == 0


def inner_names():
    """Every name the stages' modules give to a column."""
    import pathlib
    import re

    names = set()
    for module in ("language", "neardup", "components", "decontaminate", "mixing", "tokens", "shared"):
        text = pathlib.Path(corpus_pipeline.__file__).with_name("panelspark").joinpath("llm", f"{module}.py").read_text()
        names |= set(re.findall(r'(?:alias|withColumn|fresh_name)\((?:docs, )?"([A-Za-z_0-9]+)"', text)) | set(re.findall(r'"([a-z_0-9]+)": F\.', text))
    return sorted(n for n in names if n.lower() not in {"doc_id", "text", "lang", "source", "n_chars"})


def test_stages_with_every_inner_name_as_a_column(spark, sf, table):
    from pyspark.sql import functions as F

    rows = [(1, "the old town has a river " * 9, "en", "a"), (2, "the old town has a river " * 9, "en", "b"), (3, "quite another text stands here " * 5, "en", "a")]
    names = inner_names()
    assert len(names) > 40
    docs = table(rows, extra=False).withColumns({n: F.lit(f"own {n}") for n in [*names, *(f"_{n}" for n in ("kept", "twin", "leak", "row"))]})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        assert all(r[n] == f"own {n}" for r in out.collect() for n in names), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == 3


def test_a_corpus_without_languages_stays(spark, sf, table):
    docs = table([(i, f"some text number {i}", None) for i in range(5)], extra=False)
    assert corpus_pipeline.STAGES[0][1](spark, docs, sf).count() == 5
