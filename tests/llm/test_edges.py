"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names, operator by operator."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import bpe, catalog, chat, exact_dedup, jaccard, licenses, packing, sharding, topk, toxicity, url_filter

LONG = " ".join(f"word{i}" for i in range(30_000))
ROWS = [(1, "Same Text"), (2, "same text"), (3, None), (4, ""), (5, "  "), (None, "no id"), (7, LONG), (7, LONG), (8, "same text"), (9, "É é Ünï"), (10, "é é ünï"), (11, "x  y\n\nz "), (12, "a<|endoftext|>b"), (13, "a\x1cb\x85c\u2003d\u200be\ufefff <|startoftext|> Ａ ﬁ")]
SCHEMA = "doc_id long, text string"


@pytest.fixture
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    for c in ("id", "t", "h", "n", "uid", "key", "size", "part", "flagged", "p_toxic"):  # names that operators use inside
        df = df.withColumn(c, F.lit("clash"))
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def fold(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("hashed", [F.md5, lambda c: F.substr(F.md5(c), F.lit(1), F.lit(1)), lambda c: F.lit("all")])
def test_dedup(spark, docs, keep, hashed):
    got = exact_dedup.exact_dedup(docs, keep=keep, content_hash=hashed).collect()
    groups = defaultdict(list)
    for i, t in ROWS:
        groups[fold(t)].append(i)
    assert len(got) == len(ROWS) and sum(r.kept for r in got) == len(groups)
    by = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in got:
        ids = by[r.text_sha256]
        known = [i for i in ids if i is not None]
        assert r.group_size == len(ids) and r.keep_id == ((min if keep == "smallest" else max)(known) if known else None)
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0


def test_drop_copies(spark, docs):
    got = exact_dedup.drop_copies(docs)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted({(1, "Same Text"), (3, None), (5, "  "), (None, "no id"), (7, LONG), *ROWS[9:]}, key=repr)


def test_sharding(spark, docs):
    def lawful(df, shards, rows):
        got = df.collect()
        size, slots = Counter(), defaultdict(list)
        for r in got:
            assert 0 <= r.shard < shards
            size[r.shard] += r.size
            slots[r.shard].append(r.slot)
        for s, v in slots.items():
            assert sorted(v) == list(range(len(v))), s
        assert sum(len(v) for v in slots.values()) == rows
        return size

    lawful(sharding.shard_by_size(docs, 5), 5, len(ROWS))
    hot = [(i, "hot" if i % 3 == 0 else f"text {i} " + "x" * (i % 50)) for i in range(6000)]
    size = lawful(sharding.shard_by_size(spark.createDataFrame(hot, SCHEMA), 40), 40, 6000)
    assert len(size) == 40 and max(size.values()) - min(size.values()) <= 2 * max(len(t) + 16 for _, t in hot)
    crc = {r.doc_id: (r.size, r.text_crc32) for r in sharding.shard_by_size(docs, 5).collect()}
    assert crc[3] == (16, 0) and crc[9] == (16 + len("É é Ünï".encode()), zlib.crc32("É é Ünï".encode()))
    assert sharding.shard_by_size(empty(spark), 40).count() == 0


def test_splitters_are_weighted(spark):
    rows = spark.range(2000).select(F.struct(F.col("id").alias("h"), F.col("id").alias("id")).alias("key"), F.when(F.col("id") < 200, 100).otherwise(1).cast("long").alias("size"))
    total = rows.agg(F.sum("size")).first()[0]
    cuts = sharding.quantile_splitters(sharding.weighted_sample(rows, 400, float(total)), 4)
    assert len(cuts) == 3 and cuts[0][0] < 200  # nine tenths of the size lie below 200


def brute(rows, width, percent):
    def shingles(t):
        w = [x for x in fold(t).replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if x]
        return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])

    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                up[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return sorted(((d, len(s), least.get(top(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


@pytest.mark.parametrize(("width", "percent", "stars"), [(3, 90, 3), (3, 90, 1), (5, 80, 1)])
def test_jaccard(spark, docs, monkeypatch, width, percent, stars):
    monkeypatch.setattr(jaccard, "STARS", stars)
    rnd = random.Random(width * percent)
    rows = list(ROWS)
    for k in range(60):  # near copies of one text
        w = [f"w{i}" for i in range(50)]
        for _ in range(rnd.choice([0, 1, 1, 2, 4])):
            w[rnd.randrange(50)] = f"x{rnd.randrange(10**6)}"
        rows.append((100 + k, " ".join(w)))
    for k in range(40):  # small sets
        w = [f"s{i}" for i in range(rnd.randrange(3, 24))]
        if rnd.random() < 0.7:
            w[rnd.choice([0, -1])] = f"y{rnd.randrange(4)}"
        rows.append((300 + k, " ".join(w)))
    for k in range(40):  # a common passage
        rows.append((500 + k, " ".join([f"p{i}" for i in range(40)] + [f"z{rnd.randrange(10**7)}" for _ in range(rnd.randrange(4, 30))])))
    got = jaccard.jaccard_components(spark.createDataFrame(rows, SCHEMA).withColumn("n", F.lit(1)), width, percent).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute(rows, width, percent)


def test_jaccard_of_nothing(spark):
    assert jaccard.jaccard_components(empty(spark)).count() == 0


def test_subsets_join_light_sets(spark):
    light = spark.createDataFrame([(1, list(range(18))), (2, list(range(17)) + [99]), (3, list(range(18)) + [50]), (4, list(range(100, 118)))], "sid long, few array<long>")
    got = {(r.a, r.b) for r in jaccard.light_links(light, 90).collect()}
    assert got == {(1, 3)}  # 18 of 19; 1 and 2 share 17 of 19


def test_bpe(spark, docs, paths, monkeypatch):
    from tokenizers import Tokenizer

    path = paths("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    for chars in (100, bpe.BLOCK_CHARS):
        monkeypatch.setattr(bpe, "BLOCK_CHARS", chars)
        got = bpe.encode_and_decode(docs.repartition(3), path, texts=True).collect()
        assert len(got) == len(ROWS)
        by = defaultdict(list)
        for r in got:
            by[r.doc_id].append(r)
        for i, text in ROWS:
            ids = t.encode(text or "", add_special_tokens=False).ids
            for r in by[i]:
                assert (list(r.ids), r.n_tokens) == (ids, len(ids)) and r.decoded == t.decode(ids, skip_special_tokens=False)
                assert r.ids_sha256 == hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest()
    assert bpe.encode_and_decode(empty(spark), path).count() == 0
    rows = spark.createDataFrame([(1, [0, 5, 49407]), (2, []), (3, None)], "k long, ids array<int>")
    assert {r.k: r.decoded for r in bpe.decode_ids(rows, bpe.vocabulary(spark, path), "k").collect()} == {1: t.decode([0, 5, 49407], skip_special_tokens=False), 2: "", 3: ""}


def test_packing(spark, docs, paths):
    from tokenizers import Tokenizer

    path = paths("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    got = packing.pack(docs, path, 0, 64, with_ids=True).collect()
    want = Counter()
    for i, text in ROWS:
        want[i, tuple(t.encode(text or "", add_special_tokens=False).ids + [0])] += 1
    seqs = defaultdict(list)
    for r in got:
        assert zlib.crc32(np.asarray(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
        seqs[r.sequence_id].append(r)
    short = 0
    for v in seqs.values():
        v.sort(key=lambda r: r.offset)
        assert [r.offset for r in v] == list(np.cumsum([0] + [r.length for r in v[:-1]]))
        short += sum(r.length for r in v) < 64
    assert short <= 1
    for (i, ids), n in want.items():
        pieces = [r for r in got if r.doc_id == i and r.doc_tokens == len(ids)]
        assert sum(r.length for r in pieces) == n * len(ids)
        if n == 1:
            assert tuple(x for r in sorted(pieces, key=lambda r: r.start) for x in r.ids) == ids
    assert packing.pack(empty(spark), path).count() == 0


@pytest.mark.parametrize("ids", ["null", "one", "own"])
def test_packing_deals_rows_whatever_they_repeat(spark, paths, monkeypatch, ids):
    """Rows without ids, of one id, and of one text are many ranges, and more than the first sample places."""
    monkeypatch.setattr(packing, "RANGE_BYTES", 40)
    monkeypatch.setattr(packing, "SAMPLE_DOCS", 300)
    rows = [(None if ids == "null" else 5 if ids == "one" else i, "the same text" if i % 3 else f"text {i} of its own") for i in range(3000)]
    got = packing.pack(spark.createDataFrame(rows, SCHEMA).repartition(6), paths("byte_bpe_50k.json"), 0, 64).collect()
    by = Counter()
    for r in got:
        by[r.sequence_id >> 32] += r.length
    assert len(by) > 300 and max(by.values()) < 40 * sum(by.values()) / len(by)
    assert sum(by.values()) == sum(r.doc_tokens for r in got if r.start == 0) and sum(r.start == 0 for r in got) == 3000


def test_hilbert_steps_to_a_neighbour():
    grid = np.array([[x, y, z] for x in range(8) for y in range(8) for z in range(8)])
    key = packing.hilbert_index(grid, 3)
    assert sorted(key) == list(range(512))
    path = grid[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_topk(spark):
    rnd = np.random.default_rng(3)
    rows = [(i, rnd.normal(size=8).tolist()) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(40)]  # ties
    rows += [(400, None), (401, [None] * 8), (402, [float("nan")] * 8), (403, [float("inf")] * 8), (404, [0.0] * 8), (405, [1e30] * 8)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("norm", F.lit("clash"))
    w = topk.whole_numbers(v)
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.exact_top_k(w.where("id % 50 = 0"), w, 5).collect())
    whole = {i: [min(int(np.floor(256 * x)), 2**63 - 1) for x in e] for i, e in rows if e and all(x is not None and np.isfinite(x) for x in e)}
    want = []
    for q in [i for i in whole if i % 50 == 0]:
        s = [(max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(whole[q], whole[c], strict=True)))), c) for c in whole if c != q]
        want += [(q, k + 1, c, x) for k, (x, c) in enumerate(sorted(s, key=lambda z: (-z[0], z[1]))[:5])]
    assert got == sorted(want)
    none = w.where("id < 0")
    assert topk.exact_top_k(none, none, 5).count() == 0


def test_licences(spark, docs):
    known = licenses.known_licences(spark)
    mit = next(t for n, t in licenses.KNOWN if n == "MIT" and len(t) > 100)
    changed = mit.replace("sublicense", "sublicence").replace("Copyright (c) <year> <holders>", "Copyright 2020 Someone").upper().replace(",", " ;")
    rows = spark.createDataFrame([(1, changed), (2, "Text.\nReleased under the MIT licence!\nMore"), (3, None), (4, mit + " and more"), (None, "Licensed under CC BY 4.0")], SCHEMA)
    got = {r.doc_id: (r.license, r.line_licenses) for r in licenses.scan_licences(rows.withColumn("license", F.lit("x")), known).collect()}
    assert got[1][0] == "MIT" and got[2] == (None, "MIT") and got[3] == (None, "") and got[4][0] is None and got[None] == ("CC-BY-4.0", "CC-BY-4.0")
    assert licenses.scan_licences(docs, known).count() == len(ROWS) and licenses.scan_licences(empty(spark), known).count() == 0


def test_licences_in_other_lines(spark):
    import textwrap

    rows, want = [], {}
    for name, text in licenses.KNOWN:
        if len(text) < 100:
            continue
        head, *body = text.split("\n")
        notice = ["Copyright (c) 2020-2024 Jane Doe. All rights reserved."] if body[0].startswith("Copyright") else []
        body = body[len(notice) :]
        at = " ".join(body).index("COPYRIGHT HOLDERS") if name == "MIT" else 50
        forms = ["\n".join([head, *notice, *textwrap.wrap(" ".join(body), w)]) for w in (40, 60, 72, 80, 99999)]
        forms += [" ".join([head, *notice, *body]), "\n".join([head, *notice, " ".join(body)[:at], " ".join(body)[at:]])]
        forms += ["\n".join([head, "All rights reserved.", n, *body]) for n in ("© Someone", "Copyright 1999 A", "Copyright by B", "(c) 2001 C", "# Copyright (C) [year] [name]") if notice]
        for f in forms:
            rows.append((len(rows), f))
            want[len(want)] = name
        for f in ("\n".join([head, *body[:-1]]), text.replace("LIABLE", "LIKELY")):  # with words lost or changed
            rows.append((len(rows), f))
            want[len(want)] = None
    lines = ["copyright holders may", "(c) the third item", "All rights reserved by nobody"]
    rows += [(900 + i, f"Text\n{x}\nMore") for i, x in enumerate(lines)]
    got = licenses.scan_licences(spark.createDataFrame(rows, SCHEMA), licenses.known_licences(spark)).collect()
    assert {r.doc_id: r.license for r in got if r.doc_id < 900} == want
    assert len({r.digest for r in got if r.doc_id >= 900}) == 3  # text that is no notice stays


def test_chat(spark):
    calls = spark.createDataFrame(
        [(1, "a", 1, "reply", '{"turn":1,"prompt":"x"}'), (1, "b", 3, "reply", '{"prompt":5,"turn":1}'), (1, "c", 5, "reply", "no json"), (1, "d", 6, "other", "{}"), (2, None, 1, "reply", None)],
        "conv_id long, call_id string, turn long, tool string, arguments string",
    )
    results = spark.createDataFrame([(1, "a", 2, "r1"), (1, "a", 4, "again"), (1, "b", 2, "early"), (1, "z", 9, 'q"\n'), (2, None, 2, "null")], "conv_id long, call_id string, turn long, content string")
    got = {(r.conv_id, r.call_id, r.status): r for r in chat.link_tools(calls, results, chat.REPLY).collect()}
    assert got[1, "a", "linked"].json == '{"arguments":{"prompt":"x","turn":1},"call_id":"a","result":"r1","tool":"reply"}' and got[1, "a", "linked"].problem is None
    assert got[1, "a", "repeated"].result_turn == 4 and got[1, "b", "early"].problem == "prompt is no string" and got[1, "c", "unanswered"].problem == "no object"
    assert got[1, "d", "unanswered"].problem == "unknown tool" and got[1, "z", "orphan"].json.endswith('"result":"q\\"\\n","tool":null}') and (2, None, "unanswered") in got and (2, None, "orphan") in got
    assert chat.link_tools(calls.limit(0), results.limit(0), chat.REPLY).count() == 0


def test_chat_keeps_every_row(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, "user", None), (1, 1, "assistant", "y"), (1, 1, "assistant", "x"), (1, 1, "assistant", "x"), (2, 4, "assistant", "alone"), (None, 0, "user", "n"), (None, 1, "assistant", "n")]
    calls, results, _ = chat.conversation_calls(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = Counter((r.conv_id, r.call_turn, r.result_turn, r.status, r.json.split('"prompt":')[1][:3] if '"prompt":' in r.json else None, r.json.split('"result":')[1][:3]) for r in chat.link_tools(calls, results, chat.REPLY).collect())
    assert got == Counter([
        (1, 0, 1, "linked", '"a"', '"x"'), (1, 0, None, "repeated", '"a"', "nul"), (1, 0, None, "repeated", '"b"', "nul"), (1, 0, None, "repeated", None, "nul"),
        (1, None, 1, "repeated", None, '"x"'), (1, None, 1, "repeated", None, '"y"'), (2, None, 4, "orphan", None, '"al'), (None, 0, None, "unanswered", '"n"', "nul"), (None, None, 1, "orphan", None, '"n"'),
    ])
    c = spark.createDataFrame([(1, "a", 3, "reply", "{}"), (1, "b", 3, "reply", "{}")], "conv_id long, call_id string, turn long, tool string, arguments string")
    r = spark.createDataFrame([(1, "a", 2, "before"), (1, "a", 3, "beside"), (1, "a", None, "undated"), (1, "a", 5, "answer"), (1, "b", 1, "before")], "conv_id long, call_id string, turn long, content string")
    got = sorted((x.call_id, x.status, x.json.split('"result":')[1].split(",")[0]) for x in chat.link_tools(c, r, chat.REPLY).collect())
    assert got == [("a", "linked", '"answer"'), ("a", "premature", '"before"'), ("a", "premature", '"beside"'), ("a", "premature", '"undated"'), ("b", "early", "null"), ("b", "premature", '"before"')]


def test_call_order(spark):
    calls = spark.createDataFrame([("a", 5), ("b", 1), ("c", 2), ("x", 7), ("y", 8)], "call_id string, turn long")
    needs = spark.createDataFrame([("b", "a"), ("c", "b"), ("x", "y"), ("y", "x")], "call_id string, needed string")
    assert {r.call_id: r.level for r in chat.dependency_levels(calls, needs).collect()} == {"a": 0, "b": 1, "c": 2, "x": None, "y": None}
    plain = chat.dependency_levels(calls, needs.where("call_id = 'zz'"))
    assert {r.call_id: r.level for r in plain.collect()} == {"a": 0, "b": 0, "c": 0, "x": 0, "y": 0}


def test_argument_lengths(spark):
    schemas = {"t": {"q": ("string", True, 3), "n": ("integer", False)}}
    rows = [(1, '{"q":"abc"}', None), (2, '{"q":"abcd"}', "q is too long"), (3, '{"q":"éèê","n":1}', None), (4, '{"n":1}', "q is missing"), (5, '{"q":null}', "q is no string"), (6, '{"q":"a","z":1}', "extra argument"), (7, "[1]", "no object"), (8, None, "no object")]
    df = spark.createDataFrame(rows, "i long, a string, want string")
    got = df.select("i", "want", chat.argument_problem(F.lit("t"), F.col("a"), schemas).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_dependency_levels(spark):
    calls = spark.createDataFrame([(1, "1", 1), (1, "3", 3), (1, "5", 5), (1, "9", 9), (2, "3", 3), (2, "1", 8), (3, "a", 1), (3, "b", 2), (3, "c", 3), (None, "1", 1), (4, None, 1)], "conv_id long, call_id string, turn long")
    needs = [(1, "3", "1"), (1, "5", "3"), (1, "9", "7"), (2, "3", "1"), (3, "b", "c"), (3, "c", "b")]
    want = {(1, "1"): 0, (1, "3"): 1, (1, "5"): 2, (1, "9"): 0, (2, "3"): 1, (2, "1"): 0, (3, "a"): 0, (3, "b"): None, (3, "c"): None, (None, "1"): 0, (4, None): 0}
    for more in ([], [(1, "5", "1"), (3, "c", "a")]):  # one need each, then several
        got = chat.dependency_levels(calls, spark.createDataFrame(needs + more, "conv_id long, call_id string, needed string"))
        assert {(r.conv_id, r.call_id): r.level for r in got.collect()} == want
    rows = [(9, t, "assistant" if t % 2 else "user", f"t{t}") for t in range(40) if t != 20]
    c, r, n = chat.conversation_calls(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {x.call_turn: x.level for x in chat.link_tools(c, r, chat.REPLY, n).where("call_turn is not null").collect()}
    assert got == {t: t // 2 if t < 20 else t // 2 - 11 for t in range(0, 40, 2) if t != 20}


def test_urls(spark):
    urls = ["http://a.example.net/en/1", "http://a.example.net/fr/1", "https://B.Example.com/de/x?y=1", "http://x.org/fr/", "http://x.org/en/", None, "no scheme", "http://net", "http://net/", "://h?q#f", "http://anet/"]
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r.page_id: r for r in url_filter.filter_urls(rows, catalog.URL_RULES).collect()}
    assert [got[i].rule for i in range(len(urls))] == ["example.net/en/", "net/", "example.com/de/", "org/fr/", None, None, None, None, "net/", None, None]
    assert [got[i].verdict for i in (0, 1, 2, 3, 8)] == ["allow", "block", "block", "allow", "block"] and all(got[i].verdict in ("allow", "block") for i in got)
    assert (got[2].host, got[2].path) == ("b.example.com", "/de/x") and (got[9].host, got[9].path) == ("h", "") and (got[6].host, got[5].path) == ("", "")
    assert url_filter.filter_urls(rows.limit(0), catalog.URL_RULES).count() == 0


def test_url_trees_learn(spark):
    rows = spark.range(600).select(F.col("id").alias("page_id"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("http://a.com/"), F.col("id").cast("string"), F.lit("?x=1&y=2&z=3"))).otherwise(F.concat(F.lit("http://b.com/en/page-"), F.col("id").cast("string"), F.lit(".html"))).alias("url"))
    d = url_filter.described(rows).withColumn("block", (F.col("page_id") % 2 == 0).cast("int"))
    model = url_filter.fit(d.where("page_id < 400"))
    out = model.score(d.where("page_id >= 400")).select((F.col("block_probability") >= 0.5).cast("int").alias("y"), "block").collect()
    assert sum(r.y == r.block for r in out) / len(out) > 0.95


def test_toxicity(spark, docs):
    rnd = random.Random(4)
    rows, labels = [], []
    for i in range(300):
        bad = i % 4 == 0
        w = [f"w{rnd.randrange(80)}" for _ in range(40)]
        w = [x.replace("0", "a").replace("1", "b").replace("2", "c").replace("3", "d").replace("4", "e").replace("5", "f").replace("6", "g").replace("7", "h").replace("8", "i").replace("9", "j") for x in w]
        rows.append((i, " ".join(w + ["vile", "rotten"] * bad)))
        labels.append((i, int(i % 10 == 0), int(bad)))
    d, lab = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([*labels, (5, None, 1), (None, 1, 1)], "doc_id long, low_quality int, toxic int")
    chain = toxicity.fit_chain(d, lab.where("doc_id < 200 or doc_id is null"), ["low_quality", "toxic"])
    out = {r.doc_id: r.toxic for r in toxicity.judge(d.where("doc_id >= 200"), chain).collect()}
    assert sum(v == (k % 4 == 0) for k, v in out.items()) / len(out) > 0.97
    assert toxicity.judge(docs, chain).count() == len(ROWS) and toxicity.reject_toxic(docs, chain).columns == docs.columns
    assert toxicity.judge(empty(spark), chain).count() == 0
    none = toxicity.fit_chain(d, lab.limit(0), ["low_quality", "toxic"])
    assert not any(r.toxic for r in toxicity.judge(docs, none).collect())


def test_words_that_polynomial_hashes_confuse(spark):
    word = "a"
    for _ in range(11):
        word += word.translate(str.maketrans("ab", "ba"))
    rows = [(1, word), (2, word.translate(str.maketrans("ab", "ba"))), (3, word.upper()), (4, "12345678 abcdefghi x"), (5, "12345678 abcdefghj x")]
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(spark.createDataFrame(rows, SCHEMA), 3, 90).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}


def test_drop_near_copies(spark, docs):
    far = " ".join(f"u{i}" for i in range(60))
    near = far + " more"
    rows = [(5, far), (3, near), (3, "quite another text of six words"), (3, near), (None, far), (9, None), (9, None), (8, ""), (2, "quite another text of six words")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("row", F.lit(1)).withColumn("d", F.lit("x")).withColumn("id", F.lit(2)).withColumn("__gone", F.lit(0))
    got = jaccard.drop_near_copies(df)
    assert got.columns == df.columns
    # one of the rows (3, near) stays for its group, (2, ...) for the other; empty texts and null ids stay
    want = [(2, rows[-1][1]), (3, near), (8, ""), (9, None), (9, None), (None, far)]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted(want, key=repr)
    assert jaccard.drop_near_copies(empty(spark)).count() == 0 and jaccard.drop_near_copies(docs).columns == docs.columns


def test_groups_of_near_copies_meet_in_stars(spark):
    """Two groups of many near copies with a common half, and chains that no hub reaches."""
    rnd = random.Random(8)
    rows = []
    for g in range(2):
        base = [f"c{i}" for i in range(30)] + [f"g{g}x{i}" for i in range(40)]
        for k in range(150):
            w = list(base)
            for _ in range(rnd.choice([0, 1, 1, 2, 3])):
                w[rnd.randrange(70)] = f"e{g}_{rnd.randrange(30)}"
            rows.append((1000 * g + k, " ".join(w)))
    for k in range(25):
        rows.append((5000 + k, " ".join(f"h{i}" for i in range(k, k + 60))))
    got = jaccard.jaccard_components(spark.createDataFrame(rows, SCHEMA), 3, 90).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute(rows, 3, 90)


def test_toxicity_fits_are_small_jobs(spark, monkeypatch):
    """A fit is hundreds of jobs on the driver: each starts at the stored sample, in one partition, and no plan names the words."""
    seen, fit = [], toxicity._fit

    def noted(df, k, label, penalty):
        seen.append((k, len(df.rdd.toDebugString().splitlines()), df.rdd.getNumPartitions(), len(str(df.schema[f"__f{k}"].metadata))))
        return fit(df, k, label, penalty)

    monkeypatch.setattr(toxicity, "_fit", noted)
    rows = spark.createDataFrame([(i, f"{'vile' if i % 3 == 0 else 'kind'} {'poor' if i % 2 else 'good'} w{i % 40} w{i % 50}") for i in range(120)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(120)], "doc_id long, low_quality int, toxic int")
    chain = toxicity.fit_chain(rows, labels, ["low_quality", "toxic"])
    assert len(seen) == 8 and {n for _, _, n, _ in seen} == {1} and max(size for *_, size in seen) < 50
    assert max(x[1] for x in seen if x[0] == 1) <= max(x[1] for x in seen if x[0] == 0)
    assert {r.doc_id for r in toxicity.judge(rows, chain).collect() if r.toxic} == set(range(0, 120, 3))


def test_toxicity_chain_by_hand(spark, docs):
    """Scores are those of the models' formulas over words, each link fed with the probabilities before it."""
    words = ["alpha", "beta", "gamma", "delta", "vile", "rotten"]
    rnd = random.Random(7)
    rows = [(i, " ".join([rnd.choice(words[:4]) for _ in range(6)] + ["vile"] * (i % 3 == 0) + ["rotten"] * (i % 4 == 0))) for i in range(120)]
    labels = [(i, int(i % 4 == 0), int(i % 3 == 0)) for i in range(120)]
    chain = toxicity.fit_chain(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, low_quality int, toxic int"), ["low_quality", "toxic"], penalty=0.01)
    at = {w: k for k, w in enumerate(chain.vocabulary.vocabulary)}
    assert set(at) == set(words)
    for r in toxicity.judge(spark.createDataFrame(rows, SCHEMA).unionByName(docs.select("doc_id", "text")), chain).collect():
        text = dict(rows).get(r.doc_id) if r.doc_id not in dict(ROWS) else None
        if text is None:
            continue
        x = np.zeros(len(at))
        for w in set(text.split()):
            x[at[w]] = 1
        given = []
        for name, model, _ in chain.links:
            z = float(model.coefficients.toArray() @ np.concatenate((x, given)) + model.intercept)
            given.append(1 / (1 + np.exp(-z)))
            assert abs(r[f"p_{name}"] - given[-1]) < 1e-9
        assert r.toxic == (given[-1] >= chain.threshold)
    out = {r.doc_id: r.toxic for r in toxicity.judge(spark.createDataFrame(rows, SCHEMA), chain).collect()}
    assert out == {i: i % 3 == 0 for i in range(120)}


def test_packing_remembers_words_once(paths, monkeypatch):
    """Ids are the tokenizer's whatever stands between words, keys come from all signs, and memory is bounded."""
    path = paths("byte_bpe_50k.json")
    odd = ["", "\n", "\n\n", "a\n", "\na", " a", "a ", "a  b", "a \nb", "a\n b", "a\tb", "y a\t", "y a\t b c", "a\x01b c", "naïve été, ñ.  x", "a b c", "a  b", "a b\x0b", "a\x1c\x1db", "don't stop\nit's 12 34.5 %$", "a\r\nb c", "x" * 40]
    plain = bpe.tokenizer(path)
    want = [plain.encode(t, add_special_tokens=False).ids for t in odd]
    for field in (packing.FIELD, 2):  # texts of more ids than a field counts are summed apart
        monkeypatch.setattr(packing, "FIELD", field)
        words = packing.Words(path)
        for texts, ids in ((odd, want), (odd[::-1], want[::-1])):
            coded, keys = words.documents(texts)
            assert [list(memoryview(c).cast("H")) for c in coded] == ids
            signs = [[[1 - 2 * (((i + 1) * 0x9E3779B97F4A7C15 % 2**64 >> 40) >> k & 1) for k in range(packing.DIMS)] for i in x] for x in ids]
            totals = np.array([np.sum(s, axis=0) if s else [0.0] * packing.DIMS for s in signs], float)
            assert keys.tolist() == packing.curve_keys(totals, np.array([len(x) for x in ids])).tolist()
    monkeypatch.setattr(packing, "CACHE_WORDS", 100)
    words, letters = packing.Words(path), "abcdefghij"
    for i in range(500):
        words.documents([f"and {letters[i // 100]}{letters[i // 10 % 10]}{letters[i % 10]}x, so"])
        assert sum(len(v) for v in vars(words).values() if isinstance(v, dict) and v is not words.shown) <= 100 + 6
