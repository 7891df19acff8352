"""The pipeline against its stages and brute force on its own tables."""

import duckdb

import corpus_pipeline
from panelwise.llm import common
from panelwise.llm.mixing import OP7_SQL

from . import brute

SF = "/root/testdata/sf0.001"


def test_stages_and_run(spark, tmp_path):
    docs, seen = common.read(spark, SF, "documents"), {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        seen[name] = docs
        if name != "mixing":
            assert docs.columns == common.DOC_COLUMNS
    assert list(seen) == ["toxicity", "line_dedup", "near_dedup", "decontamination", "mixing"]

    cleaned = [(r.doc_id, r.text) for r in seen["line_dedup"].collect()]
    groups = brute.components(cleaned)
    near = {r.doc_id for r in seen["near_dedup"].collect()}
    assert near == {i for i, c in groups.items() if i == c}
    items = [tuple(r) for r in common.read(spark, SF, "benchmark").collect()]
    hits = brute.contamination([(i, t) for i, t in cleaned if i in near], items)
    left = {r.doc_id for r in seen["decontamination"].collect()}
    assert left == {i for i, (_, n, _) in hits.items() if not n}
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/3/*.parquet'")
    want = sorted((r[0], r[1]) for r in con.sql(f"select doc_id, taken from ({OP7_SQL}) where taken > 0").fetchall())
    got = sorted((r.doc_id, r.taken) for r in seen["mixing"].collect())
    assert got == want
    assert sorted((r.doc_id, r.taken) for r in corpus_pipeline.run(spark, SF).collect()) == got
