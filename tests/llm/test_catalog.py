"""The registered queries beside their SQL, and the pipeline beside a brute-force version, on the smallest tables."""

import duckdb
import pytest

import corpus_pipeline
from plumbline.llm import catalog
from tests.llm.test_edges import brute, fold
from tools.compare import TABLES, norm

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(catalog.SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    res = con.execute(catalog.SQL[name])
    at = [d[0] for d in res.description]
    want = sorted((tuple(norm(r[at.index(c)]) for c in cols) for r in res.fetchall()), key=repr)
    assert sorted(at) == cols and got == want


def test_pipeline(spark):
    docs = catalog.read(spark, SF, "documents")
    chain = catalog.toxicity_chain(docs, SF)
    from plumbline.llm import toxicity

    toxic = {r.doc_id for r in toxicity.judge(docs, chain).collect() if r.toxic}
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect() if r.doc_id not in toxic]
    first = {}
    for i, t in sorted(rows):
        first.setdefault(fold(t), i)
    rows = [(i, t) for i, t in rows if first[fold(t)] == i]
    kept = {i for i, _, c in brute(rows, 5, 80) if i == c}
    got = {r.doc_id for r in corpus_pipeline.run(spark, SF).select("doc_id").distinct().collect()}
    assert got == kept
