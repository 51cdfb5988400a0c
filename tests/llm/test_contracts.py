"""The registered queries without SQL beside plain versions of what they have to return, over the whole smallest tables."""

import hashlib
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
from tokenizers import Tokenizer

from plumbline.llm import catalog
from tests.llm.test_edges import brute

SF = "/root/testdata/sf0.001"


def table(name, *columns):
    return duckdb.sql(f"select {', '.join(columns)} from '{SF}/{name}.parquet'").fetchall()


def rows_of(spark, name):
    return catalog.QUERIES[name](spark, SF).collect()


def test_jaccard_join(spark):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows_of(spark, "op1_jaccard_join")), key=repr)
    assert got == brute(table("documents", "doc_id", "text"), 3, 90)
    assert len({c for _, _, c in got}) < len(got)  # the table has near copies


def test_sharding(spark):
    got = rows_of(spark, "op3_sharding")
    want = {i: (len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in table("documents", "doc_id", "text")}
    assert {r.doc_id: (r["size"], r.text_crc32) for r in got} == want and len(got) == len(want)
    slots, size = defaultdict(list), Counter()
    for r in got:
        assert 0 <= r.shard < 40 and r.law == "bytes" and r.grown_shard is None
        slots[r.shard].append(r.slot)
        size[r.shard] += r["size"]
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(size.values()) <= sum(size.values()) / 40 + max(s for s, _ in want.values())  # no shard exceeds its share by more than one row


def test_bpe(spark):
    t = Tokenizer.from_file(catalog.vocabulary_file("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows_of(spark, "op5_bpe")}
    docs = table("documents", "doc_id", "text")
    assert len(got) == len(docs)
    for i, text in docs:
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert got[i] == (len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest())


def test_packing(spark):
    t = Tokenizer.from_file(catalog.vocabulary_file("byte_bpe_50k.json"))
    t.no_truncation()
    t.no_padding()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows_of(spark, "op9_packing"):
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    docs = table("documents", "doc_id", "text")
    assert set(pieces) == {i for i, _ in docs}
    total = 0
    for i, text in docs:
        ids, at = [*t.encode(text or "", add_special_tokens=False).ids, 0], 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(np.asarray(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
        total += at
    for v in sequences.values():
        v.sort(key=lambda r: r.offset)
        assert [r.offset for r in v] == [0, *np.cumsum([r.length for r in v])[:-1]] and sum(r.length for r in v) <= 1024
    assert total / (1024 * len(sequences)) > 0.98


def test_url_rules(spark):
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows_of(spark, "op10_url_filter")}
    pages = table("pages", "page_id", "url")
    assert len(got) == len(pages)
    for i, url in pages:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
        fits = [(h + p, v) for v, h, p in catalog.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, None))
        assert got[i][:3] == (host, path, rule)
        assert got[i][3] == verdict if rule else got[i][3] in ("allow", "block")
