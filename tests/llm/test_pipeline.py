"""Each stage of the pipeline against brute force on its own input."""

import corpus_pipeline
from corpusmill.llm import decontaminate, line_dedup, quality_crf, simhash
from corpusmill.llm.common import saved, table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    bench = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    for name, stage in corpus_pipeline.STAGES:
        rows = docs.collect()
        out = saved(stage(spark, docs, SF), name)
        got = out.collect()
        if name != "tokenize":
            assert out.columns == docs.columns
        texts = {r.doc_id: r.text for r in rows}
        if name == "quality":
            judged = quality_crf.judged(docs, table(spark, SF, "labels")).collect()
            assert {r.doc_id for r in got} == {r.doc_id for r in judged if r.predicted}
        elif name == "line_dedup":
            gone = line_dedup.brute_force(list(texts.items()))
            want = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in set(gone.get(i, []))) for i, t in texts.items()}
            assert {r.doc_id: r.text for r in got} == {i: t for i, t in want.items() if i not in gone or t.strip()}
            assert all(r.n_chars == len(r.text) for r in got)
        elif name == "near_duplicates":
            assert {r.doc_id for r in got} == {c for _, _, c in simhash.brute_force(list(texts.items()))}
        elif name == "decontaminate":
            assert {r.doc_id for r in got} == {r[0] for r in decontaminate.brute_force(list(texts.items()), bench) if not r[-1]}
        else:
            assert {r.doc_id for r in got} == set(texts) and all(r.round_trip and r.n_tokens == len(r.input_ids) for r in got)
        docs = out


def test_empty_documents(spark):
    docs = table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = saved(stage(spark, docs, SF), "empty")
        assert docs.count() == 0
