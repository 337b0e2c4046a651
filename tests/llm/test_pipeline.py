"""The pipeline stage by stage, on documents with planted cases."""

from __future__ import annotations

import corpus_pipeline
from docloom.llm import packing, pii

SF = "/root/testdata/sf0.01"


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    columns = docs.dtypes
    seen = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.materialize(stage(spark, docs, SF), f"test-{i}")
        seen[name] = docs
        if i + 1 < len(corpus_pipeline.STAGES):
            assert docs.dtypes == columns, name
    ids = {name: {r.doc_id for r in df.select("doc_id").collect()} for name, df in list(seen.items())[:-1]}
    clean = [i for i, r in labels.items() if not r.toxic]
    assert sum(i in ids["toxicity"] for i in clean) >= 0.97 * len(clean)
    toxic = [i for i, r in labels.items() if r.toxic]
    assert sum(i not in ids["toxicity"] for i in toxic) >= 0.7 * len(toxic)
    good = [i for i, r in labels.items() if r.quality == 1 and i in ids["toxicity"]]
    assert sum(i in ids["quality classifier"] for i in good) >= 0.97 * len(good)
    bad = [i for i, r in labels.items() if r.quality == 0]
    assert sum(i not in ids["quality classifier"] for i in bad) >= 0.9 * len(bad)
    texts = [r.text for r in seen["MinHash near-dedup"].select("text").collect()]
    assert len(texts) == len(set(texts)) and ids["PII"] == ids["MinHash near-dedup"]
    redacted = {r.doc_id: r for r in seen["PII"].collect()}
    for r in seen["MinHash near-dedup"].collect():
        found = pii.spans(r.text)
        assert redacted[r.doc_id].text == pii.redact(r.text, found) and redacted[r.doc_id].n_chars == len(redacted[r.doc_id].text)
    packed = seen["best-fit packing"].collect()
    assert {i for r in packed for i in r.doc_ids} == ids["PII"]
    assert all(r.used == len(r.text) <= packing.CAPACITY for r in packed)
    assert sum(sum(r.lengths) for r in packed) == sum(len(r.text) for r in redacted.values())
    for r in packed:
        pieces = [redacted[i].text[s : s + n] for i, s, n in zip(r.doc_ids, r.starts, r.lengths)]
        assert r.text == corpus_pipeline.SEPARATOR.join(pieces)
    assert corpus_pipeline.run(spark, SF).count() == len(packed)


ODD = [
    (1, None), (2, ""), (3, "  \n "), (None, "some plain text of a row without an id"), (4, "the same text in two rows of one id"), (4, "the same text in two rows of one id"),
    (5, "the same text in two rows of one id"), (6, " ".join(f"w{i}" for i in range(60_000))), (7, "write to ann.b7@x.example.org about it"),
]


def test_stages_on_odd_rows(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    more = ["cast(null as bigint) as n_chars", "1 as keep", "'x' as node", "2L as t", "true as held", "'y' as x", "3 as length", "4 as grp", "5 as n", "6 as used", "array(7) as texts"]
    table = spark.createDataFrame(ODD, "doc_id bigint, text string").selectExpr("*", *more)
    for docs, want in ((table, [[*range(1, 8), 4, None], [4, 4, 5, 6, 7, None], [4, 6, 7, None], [4, 6, 7, None]]), (table.limit(0), [[]] * 4)):
        for (name, stage), ids in zip(corpus_pipeline.STAGES, want):
            columns = docs.dtypes
            docs = corpus_pipeline.materialize(stage(spark, docs, str(tmp_path)), "test-odd")
            # each stage by itself, too, on all odd rows
            assert corpus_pipeline.materialize(stage(spark, table, str(tmp_path)), "test-odd").count() > 0
            if name == "PII" and ids:
                found = {r.doc_id: r for r in docs.collect()}
                assert found[7].text == "write to [EMAIL] about it" and found[7].n_chars == len(found[7].text)
            assert docs.dtypes == columns and sorted(map(str, [r.doc_id for r in docs.collect()])) == sorted(map(str, ids)), name
        last = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
        assert all(r.used == len(r.text) <= packing.CAPACITY for r in last) and {i for r in last for i in r.doc_ids} == set(want[-1])
