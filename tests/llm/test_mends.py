"""Small cases: several blocks of windows, urls without a host, shards of repeated and null keys, repeated ids."""

from corpusmill.llm import decontaminate, licenses, quality_crf, sharding, url_filter


def test_windows_in_several_blocks_and_long_items_in_parts(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PART", 7)
    long = " ".join(f"w{k}" for k in range(60))
    items = [("a", long), ("b", "Few words"), ("c", "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"), ("d", None), ("e", long)]
    docs = [(1, "x " + long + " y"), (2, "so few words here"), (3, " ".join(f"w{k}" for k in range(3, 17))), (4, None), (4, "one two"), (5, items[2][1] + " few words")]
    got = decontaminate.judged(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id string, text string"), max_words=30)
    rows = [(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got.collect()]
    assert sorted(rows) == sorted(decontaminate.brute_force(docs, items))


def test_urls_without_a_host_are_judged(spark):
    df = spark.createDataFrame([("file:///adserver/x",), ("http:///popunder/",), ("file:///y",), (None,)], "url string")
    got = {r.url: r.verdict for r in url_filter.filtered(df, ()).collect()}
    assert got == {"file:///adserver/x": "block", "http:///popunder/": "block", "file:///y": "allow", None: "allow"}


def test_shards_are_written_whole(spark, tmp_path):
    rows = [(k % 5 if k % 7 else None, "text " * (k % 11), k) for k in range(200)] + [(9, "same text", 0)] * 30
    df = spark.createDataFrame(rows, "doc_id int, text string, other int")
    sharding.write_shards(df, str(tmp_path / "out"), limit=100)
    back = spark.read.option("pathGlobFilter", "*.parquet").parquet(str(tmp_path / "out")).select("doc_id", "text", "other")
    assert sorted(map(tuple, back.collect()), key=str) == sorted(rows, key=str)


def test_the_least_lines_are_those_of_a_full_sort(spark):
    df = spark.createDataFrame([("\n".join(f"line {k} {j}" for j in range(50)) + "\nCopyright x\n",) for k in range(60)], "text string")
    got = [(r.p, r.h) for r in licenses._least(df, "text", 20).orderBy("h").collect()]
    lines = {f"line {k} {j}" for k in range(60) for j in range(50)}
    from pyspark.sql import functions as F

    full = [(r.p, r.h) for r in spark.createDataFrame([(x,) for x in lines], "p string").withColumn("h", F.xxhash64("p")).orderBy("h").limit(20).collect()]
    assert got == full


def test_a_repeated_id_is_fitted_once(spark):
    docs = spark.createDataFrame([(k % 4, f"Some text {k}.\nMore of it.") for k in range(40)], "doc_id int, text string")
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 1), (3, 0)], "doc_id int, quality int")
    model = quality_crf.trained(docs, labels)
    assert model == model and set(model) == {"w", "trans"}


def test_near_duplicates_go_by_row_not_by_id(spark):
    from corpusmill.llm import simhash

    rows = [(1, "a b c d e"), (5, "a b c d e"), (5, "quite another text than that"), (None, "a b c d e"), (None, "x y z of its own kind")]
    left = simhash.deduplicated(spark.createDataFrame(rows, "doc_id int, text string"))
    assert sorted(map(tuple, left.collect()), key=str) == sorted([rows[0], rows[2], rows[4]], key=str)
