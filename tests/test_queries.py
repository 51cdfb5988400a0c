"""Every registered query of the engine beside its DuckDB SQL, on the smallest tables."""

import duckdb
import pytest

from plumbline.plans import registry
from tools.compare import TABLES, norm

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name not in registry.ORACLE:
        assert cols
        return
    res = con.execute(registry.ORACLE[name])
    at = [d[0] for d in res.description]
    assert sorted(at) == cols
    want = sorted((tuple(norm(r[at.index(c)]) for c in cols) for r in res.fetchall()), key=repr)
    assert got == want


def test_duplicates_are_found_in_blocks_and_among_all(spark):
    import re

    rows = [(i, x, lang) for i, x, lang in duckdb.sql(f"select doc_id, text, lang from '{SF}/documents.parquet' where text is not null order by 1").fetchall()]
    for name, least, block in (("dedupe_pairs", 0.7, True), ("dedupe_pairs_all", 0.5, False)):
        first = {}
        for i, x, lang in rows:
            first.setdefault((x, lang if block else None), i)
        sets = sorted((i, lang, set(re.findall("[a-z0-9]+", x.lower()))) for (x, lang), i in first.items())
        want = {(i, j) for k, (i, p, x) in enumerate(sets) for j, q, y in sets[k + 1 :] if p == q and x & y and len(x & y) / len(x | y) >= least}
        got = registry.QUERIES[name](spark, SF).collect()
        assert want and len(got) == len(want) and {(r.a, r.b) for r in got} == want


def test_copies_of_one_set_of_words(spark):
    from plumbline.operators.matching import duplicate_groups, duplicate_pairs

    texts = ["pump set at line four"] * 4 + ["line four pump set at", "pump set at line five", "", None, "other matter"]
    df = spark.createDataFrame([(i, t, "d" if i != 3 else None) for i, t in enumerate(texts)], "id long, text string, discipline string")
    got = {(r.a, r.b): r.similarity for r in duplicate_pairs(df, 0.6, ("discipline",)).collect()}
    same = [0, 1, 2, 4]
    want = {(a, b): 1.0 for a in same for b in same if a < b} | {(a, 5): 0.667 for a in same}
    assert got == want
    groups = {(r.primary, r.duplicate) for r in duplicate_groups(duplicate_pairs(df, 0.6, ("discipline",))).collect()}
    assert groups == {(0, 1), (0, 2), (0, 4), (0, 5)}


def test_candidates_are_not_shuffled(spark, monkeypatch):
    import random

    from plumbline.operators import matching

    rnd = random.Random(3)
    common = [f"c{k}" for k in range(60)]
    texts = [" ".join(rnd.sample(common, rnd.randrange(8, 40)) + [f"r{rnd.randrange(40)}"]) for _ in range(300)]
    texts += [" ".join(rnd.sample(t.split(), len(t.split()) - 1)) for t in texts[:80]]
    df = spark.createDataFrame([(i, t, i % 2) for i, t in enumerate(texts)], "id long, text string, k int")
    stored, keep = {}, matching.scratch
    monkeypatch.setattr(matching, "scratch", lambda d, name: stored.setdefault(name, keep(d, name)) if name != "cells" else keep(d, name))
    monkeypatch.setattr(matching, "BLOCK_WORDS", 500)  # several blocks a cell
    got = {(r.a, r.b) for r in matching.duplicate_pairs(df, 0.6, ("k",)).collect()}
    sets = [set(t.split()) for t in texts]
    want = {(i, j) for j in range(len(sets)) for i in range(j) if i % 2 == j % 2 and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.6}
    assert len(want) > 60 and got == want
    distinct = {(min(i, j), max(i, j)) for i, j in want if sets[i] != sets[j]}
    assert len(distinct) <= stored["met"].count() <= 1.2 * len(distinct) + 5  # what leaves the blocks is what is alike
