"""Text ids, clashing column names, nulls, repeated rows and empty tables, through every operator on documents and every stage of the pipeline."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusmill.llm import bm25_topk, decontaminate, line_dedup, quality_crf, quality_rules, simhash, url_filter

CLASHES = ("__id", "__version", "__gone", "__target", "__found", "__row", "best", "found", "gone", "gone_id", "_gone_id", "target", "row_number", "id", "key", "n", "a", "b", "stratum", "label", "score2", "with space", "do.t")


def texts():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    lines = lambda n: "\n".join(" ".join(rng.choices(words, k=12)) for _ in range(n))
    some = [lines(rng.randrange(1, 7)) for _ in range(25)]
    junk = ["### $$$ %%% &&&\n*** ***"] * 6
    return [*some, some[0], some[1] + " more", *junk, None, "", " \n\t", "x " * 3000]


def documents(spark, text_ids):
    rows = [(f"d{i:03}" if text_ids else i, t, "en", "s", len(t or "")) for i, t in enumerate(texts())]
    rows += [rows[2], (rows[3][0], "another text of the same id", "fr", None, 5), (None, "no id", None, "s", 5)]
    df = spark.createDataFrame(rows, f"doc_id {'string' if text_ids else 'long'}, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit(c).alias(c) for c in CLASHES])


def labels(spark, docs):
    return docs.where("text is not null and doc_id is not null").select("doc_id", F.when(F.contains("text", F.lit("###")), 0).otherwise(1).alias("quality")).distinct()


def operators(spark, docs):
    benchmark = docs.select(F.col("doc_id").alias("item_id"), F.col("text")).limit(3)
    return {
        "crf": lambda: quality_crf.judged(docs, labels(spark, docs)),
        "url": lambda: url_filter.filtered(docs.withColumn("url", F.concat(F.lit("http://a.com/en/"), "doc_id")), [url_filter.host_rule("com", "/en/", "block")]),
        "simhash": lambda: simhash.deduplicated(docs),
        "lines": lambda: line_dedup.deduplicated(docs),
        "windows": lambda: decontaminate.judged(docs, benchmark),
        "blocks of windows": lambda: decontaminate.judged(docs, benchmark, max_words=50),
        "clean": lambda: decontaminate.decontaminated(docs, benchmark),
        "rules": lambda: quality_rules.judged(docs, labels(spark, docs)),
    }


@pytest.mark.parametrize("text_ids", [False, True])
@pytest.mark.parametrize("name", ["crf", "url", "simhash", "lines", "windows", "blocks of windows", "clean", "rules"])
def test_other_columns_come_through(spark, name, text_ids):
    docs = documents(spark, text_ids)
    out = operators(spark, docs)[name]()
    rows = out.select(*[F.col(f"`{c}`") for c in CLASHES]).distinct().collect()
    assert [tuple(r) for r in rows] == [CLASHES]
    assert out.count() == docs.count() or name in ("simhash", "clean")


def test_text_ids_give_what_numbers_give(spark):
    runs = []
    for text_ids in (False, True):
        docs = documents(spark, text_ids)
        asked = docs.where(F.col("doc_id").isNotNull()).withColumnRenamed("doc_id", "query_id").select("query_id", "text")
        number = lambda c: F.regexp_replace(F.col(c).cast("string"), "^d0*(?=.)", "").cast("long").alias(c)
        found = bm25_topk.top_k(docs, asked, k=3).select(number("query_id"), "rank", number("doc_id"), "score")
        scores = quality_crf.judged(docs.where(F.col("doc_id").isNotNull()), labels(spark, docs))
        assert scores.count() == docs.count() - 1 and scores.where("score is null").count() == 0
        runs.append(sorted(map(tuple, found.collect())))
    assert runs[0] == runs[1] and len(runs[0]) > 50


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_take_any_rows(spark, tmp_path, stage):
    f = dict(corpus_pipeline.STAGES)[stage]
    docs = documents(spark, False)
    labels(spark, docs).write.parquet(str(tmp_path / "labels.parquet"))
    docs.select(F.col("doc_id").alias("item_id"), "text").limit(2).write.parquet(str(tmp_path / "benchmark.parquet"))
    out = f(spark, docs, str(tmp_path))
    last = stage == corpus_pipeline.STAGES[-1][0]
    assert out.columns == (["doc_id", "input_ids", "n_tokens", "round_trip"] if last else docs.columns)
    assert 0 < out.count() <= docs.count()
    empty = f(spark, docs.limit(0), str(tmp_path))
    assert empty.collect() == [] and empty.columns == out.columns


def test_a_rule_whose_only_token_goes_on_is_found_by_its_beginning(spark):
    assert url_filter.tokens("||casino*^") == ["casi*"] and url_filter.tokens("||cas*^") == [] and url_filter.tokens("/ads/banner*x") == ["ads", "bann*"]
    urls = ["http://www.casinoroyal.net/x", "http://casino/", "http://a.b/casino/", "http://mycasino.com/", "http://cas.com/"]
    pages = spark.createDataFrame([(u,) for u in urls], "url string")
    got = {r.url: r.verdict for r in url_filter.filtered(pages, [], general=[url_filter.Rule("||casino*^"), url_filter.Rule("||xyz*q")]).collect()}
    assert [got[u] for u in urls] == ["block", "block", "allow", "allow", "allow"]
