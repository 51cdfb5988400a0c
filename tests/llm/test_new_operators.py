"""Codes, filter audit and language-model scores: against plain versions, and at their edges."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import catalog, codes, context_tree, filter_audit

LONG = " ".join(f"word{i}" for i in range(30_000))
TEXTS = [(1, "Same Text"), (2, "same text"), (3, None), (4, ""), (5, "  "), (None, "no id"), (7, LONG), (7, LONG), (8, "same text"), (9, "É é Ünï"), (11, "x  y\n\nz "), (13, "a\x1cb\x85c d​e﻿f"), (20, "THE END"), (None, "same text")]


def plain_codes(rows, parts, entries, rounds):
    """(code, error) of rows (id, whole components), rescanned in every round; codebooks by part."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = -(-len(rows[0][1]) // parts)
    cut = [[v[p * width : (p + 1) * width] + [0] * (width - len(v[p * width : (p + 1) * width])) for p in range(parts)] for _, v in rows]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda: [[min(range(len(books[p])), key=lambda e: (dist(c[p], books[p][e]), e)) for p in range(parts)] for c in cut]
    for _ in range(rounds):
        at = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [c[p] for c, a in zip(cut, at, strict=True) if a[p] == e]
                if mine:
                    books[p][e] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    at = assign()
    out = [(r[0], bytes(a).hex(), min(sum(dist(c[p], books[p][a[p]]) for p in range(parts)), 2**63 - 1)) for r, c, a in zip(rows, cut, at, strict=True)]
    return out, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


@pytest.mark.parametrize("rounds", [0, 1, 2, 5])
def test_codes(spark, rounds):
    rnd = random.Random(rounds)
    rows = [(i, [rnd.gauss(i % 7, 0.3) for _ in range(10)], i % 3 if i % 5 else None) for i in range(400)]
    rows += [(1000 + i, rows[3][1], 1) for i in range(50)]  # ties and copies
    rows += [(3, rows[5][1], 2), (None, rows[6][1], None), (-1, [0.0] * 10, 0)]
    bad = [(2000, None, 1), (2001, [None] * 10, 1), (2002, [float("nan")] * 10, 1), (2003, [float("inf")] * 10, 1)]
    short = [(2004, [1.0] * 3, 1), (2005, [], 77)]
    v = spark.createDataFrame(rows + bad + short, "vec_id long, embedding array<double>, label int").withColumn("code", F.lit("clash")).withColumn("v", F.lit(1)).withColumn("id", F.lit("x"))
    out, books = codes.compress(v.repartition(5), parts=4, entries=16, rounds=rounds)
    whole = [(i, [math.floor(256 * x) for x in e]) for i, e, _ in rows]
    want, digest = plain_codes(whole, 4, 16, rounds)
    got = codes.label_errors(out).collect()
    assert sorted(((r.id, r.code, r.error) for r in got if r.code), key=repr) == sorted(want, key=repr) and books.sha256() == digest
    assert {(r.id, r.error) for r in got if r.code is None} == {(2004, None), (2005, None)} and len(got) == len(rows) + 2
    total = defaultdict(int)
    for r in got:
        total[r.label] += r.error or 0
    assert all(r.label_error == (total[r.label] if r.label != 77 else None) for r in got)


def test_codes_at_the_ends(spark):
    rows = [(i, [1e30 if i % 3 else -1e30, float(i)], 0) for i in range(9)]
    out, books = codes.compress(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), parts=2, entries=4, rounds=2)
    clip = lambda x: max(-(2**63), min(2**63 - 1, math.floor(256 * x)))
    want, digest = plain_codes([(i, [clip(x) for x in e]) for i, e, _ in rows], 2, 4, 2)
    assert sorted((r.id, r.code, r.error) for r in out.collect()) == sorted(want) and books.sha256() == digest
    none, books = codes.compress(out.sparkSession.createDataFrame([], "vec_id long, embedding array<float>, label int"))
    assert codes.label_errors(none).count() == 0 and books is None


def test_bounds_spare_distances_and_hold():
    """Bounds carried by net displacement stay true however codebooks move, and most parts of late rounds measure nothing."""
    rnd = np.random.default_rng(5)
    x = np.concatenate([rnd.normal(c, 12, (300, 4)) for c in rnd.uniform(-900, 900, (12, 4))]).round().astype(np.int64)
    history = [x[rnd.permutation(len(x))[:16]][None]]
    state, scanned = None, []
    for _ in range(8):
        at = codes.Assigner(list(history))
        state = at.first(x, 0) if state is None else at.again(x, 0, *state)
        scanned.append(at.scanned)
        d = codes.distances(x, history[-1][0])
        assert (state[0] == d.argmin(1)).all()
        new = history[-1].copy()
        for e in range(16):
            if (state[0] == e).any():
                new[0, e] = x[state[0] == e].sum(0) // (state[0] == e).sum()
        # the books swing back, which a running sum of drifts would add up
        history.append(new if len(history) % 2 else history[-1] + (new - history[-1]) // 2)
    assert scanned[0] == x.shape[0] * 16 and max(scanned[4:]) < scanned[0] / 2


def failed(t, ids, i):
    t = t or ""
    ws = [w for w in t.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    mask = (len(ws) < 200) | (100 * len(set(ws)) < 50 * len(ws)) << 1 | (100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t)) << 2 | any(c in "#$%&*|" for c in t) << 3
    return mask | (i is not None and any(x is not None and x < i for x in ids)) << 4


@pytest.mark.parametrize("hashed", [F.xxhash64, lambda c: F.length(c), lambda c: F.lit(5)])
def test_filter_audit(spark, hashed):
    many = [(100 + i, "lorem ipsum " * 150 if i % 4 else f"Own {i} #", f"s{i % 3}") for i in range(60)]
    rows = [(i, t, s) for (i, t), s in zip(TEXTS, ["a", None, "", "b"] * 9, strict=False)] + many + [(200, "lorem ipsum " * 150, None)]
    labels = [(1, 1, 0), (1, 0, 0), (2, 0, 1), (7, 1, 1), (None, 1, 1), (105, None, 1), (999, 1, 1), *[(i, i % 2, int(i % 5 == 0)) for i in range(110, 150)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("mask", F.lit("clash")).withColumn("h", F.lit(1)).withColumn("part", F.lit(2)).withColumn("t", F.lit(3))
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    sets = filter_audit.failed_sets(docs.repartition(4), content_hash=hashed)
    by = defaultdict(list)
    for i, t, _ in rows:
        by[t or ""].append(i)
    want = Counter((i, s or "", failed(t, by[t or ""], i)) for i, t, s in rows)
    assert Counter((r.id, r.part, r["mask"]) for r in sets.collect()) == want
    got = {(r.part, r.filter_order, r.step): r for r in filter_audit.audit(filter_audit.set_counts(sets, lab)).collect()}
    parts = {p for _, p, _ in want}
    assert len(got) == 600 * len(parts)
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, x in labels if x == 1 and i is not None}
    for p in parts:
        mine = [(i, m) for (i, q, m), n in want.items() if q == p for _ in range(n)]
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = mine
            for f in order:
                shapley[f] += sum(m >> "ABCDE".index(f) & 1 for _, m in left)
                left = [x for x in left if not x[1] >> "ABCDE".index(f) & 1]
        for order in list(permutations("ABCDE"))[::7]:
            left = mine
            for k, f in enumerate(order):
                b = 1 << "ABCDE".index(f)
                gone, stay = [x for x in left if x[1] & b], [x for x in left if not x[1] & b]
                r = got[p, "".join(order), k + 1]
                assert (r.kept, r.removed, r.redundant) == (len(stay), len(gone), sum(bool(m & b) for _, m in mine) - len(gone))
                assert (r.unique_fails, r.good_lost, r.toxic_lost) == (sum(m == b for _, m in mine), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone))
                assert r.shapley == shapley[f]
                left = stay
    none = filter_audit.failed_sets(docs.limit(0))
    assert filter_audit.audit(filter_audit.set_counts(none, lab)).count() == 0


def test_sketch_clears_unique_texts_alone(spark):
    rows = spark.range(20_000).select(F.xxhash64(F.when(F.col("id") % 10 == 0, F.col("id") % 1000).otherwise(F.col("id"))).alias("h"))
    sketch = filter_audit.counting_sketch(rows.repartition(7), filter_audit.sketch_size(20_000))
    repeat = filter_audit.may_repeat(spark, sketch)
    open_ = {r.h for r in rows.where(repeat("h")).collect()}
    n = Counter(r.h for r in rows.collect())
    assert {h for h, k in n.items() if k > 1} <= open_ and len(open_) < 0.1 * len(n)
    full = filter_audit.counting_sketch(rows, filter_audit.BLOCK)  # a sketch that is too small clears nothing, and nothing wrongly
    assert rows.where(filter_audit.may_repeat(spark, full)("h")).distinct().count() >= len({h for h, k in n.items() if k > 1})


def tokens(t):
    return (t or "").encode().lower().split() + [b"\xff"]


def plain_tree(train, depth):
    """log10 probabilities of words by context-tree weighting, in dictionaries."""
    count, kids = defaultdict(lambda: [0, 0]), defaultdict(set)

    def steps(w):
        data = b" " + w + (b"" if w == b"\xff" else b" ")
        for i in range(1, len(data)):
            past = data[max(0, i - depth) : i]
            for k in range(8):
                node = (data[i] | 256) >> (8 - k)
                yield [(past[len(past) - d :] if d else b"", node) for d in range(len(past) + 1)], data[i] >> (7 - k) & 1

    for w, n in train.items():
        for path, bit in steps(w):
            for at in path:
                count[at][bit] += n
            for up, low in zip(path, path[1:], strict=False):
                kids[up].add(low)
    own = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    known = {}

    def weighed(at):  # (log of the weighted probability, share of the own estimate)
        if at not in known:
            e = own(*count[at]) if at in count else 0.0
            if len(at[0]) == depth or at[0][:1] == b" ":
                known[at] = e, 1.0
            else:
                below = sum(weighed(k)[0] for k in kids[at]) if at in kids else 0.0
                top = max(e, below)
                known[at] = top + math.log(math.exp(e - top) + math.exp(below - top)) - math.log(2), 1 / (1 + math.exp(min(below - e, 700)))
        return known[at]

    def score(w):
        lp = 0.0
        for path, bit in steps(w):
            p, rest = 0.0, 1.0
            for at in path:
                a, b = count[at] if at in count else (0, 0)
                share = weighed(at)[1]
                p += rest * share * (b + 0.5) / (a + b + 1)
                rest *= 1 - share
            lp += math.log10(p if bit else 1 - p)
        return lp

    return score


def check_scores(rows, got):
    train = Counter()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    for i, t in rows:
        if not held(i):
            train.update(tokens(t))
    n, v, score = sum(train.values()), len(train), plain_tree(train, context_tree.DEPTH)
    lp = {}
    want = []
    for i, t in rows:
        ws = tokens(t)
        for w in ws:
            if w not in lp:
                lp[w] = score(w)
        want.append((i, held(i), len(ws), sum(train[w] > 0 for w in ws), n, sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), sum(lp[w] for w in ws), sum(map(len, ws)) + len(ws) - 1))
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=lambda r: repr(tuple(r)[:5])), sorted(want, key=lambda r: repr(r[:5])), strict=True):
        assert tuple(g)[:5] == w[:5] and g.n_bytes == w[7]
        assert g.base_score == pytest.approx(w[5], rel=1e-9, abs=1e-9) and g.score == pytest.approx(w[6], rel=1e-7, abs=1e-7)
        assert g.bits_per_byte == pytest.approx(-w[6] / math.log10(2) / w[7], rel=1e-7)


def test_scores(spark, monkeypatch):
    monkeypatch.setattr(context_tree, "BLOCK_BYTES", 20_000)  # many blocks and shards; task code sees the module's own values
    rnd = random.Random(2)
    rows = TEXTS + [(100 + i, " ".join(rnd.choice(["the", "theme", "Thesis", "a", "an", "and", "x" * 30, "naïve", "ñandú"]) for _ in range(rnd.randrange(40)))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("id", "word", "block", "rank", "c", "lp", "score"):
        docs = docs.withColumn(c, F.lit("clash"))
    check_scores(rows, context_tree.score(docs.repartition(3)).collect())
    assert context_tree.score(docs.limit(0)).count() == 0
    ids = [i for i in range(300) if zlib.crc32(str(i).encode()) % 10 == 0][:5]
    got = context_tree.score(spark.createDataFrame([(i, "ab") for i in ids], "doc_id long, text string")).collect()
    assert all(r.held_out and r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 and r.score == pytest.approx(-32 * math.log10(2)) for r in got)


def test_registered_scores(spark):
    """Equal to the plain version, and texts like those of training take few bits a byte."""
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in catalog.read(spark, sf, "documents").collect()]
    got = catalog.QUERIES["op13_lm_score"](spark, sf).collect()
    check_scores(rows, got)
    held = [r for r in got if r.held_out and r.n_tokens > 20]
    assert held and sum(r.bits_per_byte for r in held) / len(held) < 4 and all(r.score < 0 for r in got)


def test_scores_broadcast_nothing(spark, monkeypatch):
    """Tables that grow with the corpus meet by shuffles, however small their files are."""
    plans, write = [], context_tree.stored
    seen = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(context_tree, "stored", lambda df, name: (seen(df), write(df, name))[1])
    seen(context_tree.score(spark.createDataFrame(TEXTS, "doc_id long, text string")))
    assert sum("SortMergeJoin" in p for p in plans) >= context_tree.DEPTH + 3 and not any("Broadcast" in p for p in plans)


def whole_tree(train, depth):
    """log10 probability of byte streams (the first byte given) by context-tree weighting, in dictionaries."""
    count, kids, known = defaultdict(lambda: [0, 0]), defaultdict(set), {}

    def steps(data):
        for i in range(1, len(data)):
            past = data[max(0, i - depth) : i]
            for k in range(8):
                yield [(past[len(past) - d :] if d else b"", (data[i] | 256) >> (8 - k)) for d in range(len(past) + 1)], data[i] >> (7 - k) & 1

    for data in train:
        for path, bit in steps(data):
            for at in path:
                count[at][bit] += 1
            for up, low in zip(path, path[1:], strict=False):
                kids[up].add(low)

    def weighed(at):
        if at not in known:
            a, b = count.get(at, (0, 0))
            e = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
            if len(at[0]) == depth or at[0][:1] == b"\xfe":
                known[at] = e, 1.0
            else:
                below = sum(weighed(k)[0] for k in kids.get(at, ()))
                top = max(e, below)
                known[at] = top + math.log(math.exp(e - top) + math.exp(below - top)) - math.log(2), 1 / (1 + math.exp(min(below - e, 700)))
        return known[at]

    def score(data):
        lp = 0.0
        for path, bit in steps(data):
            p, rest = 0.0, 1.0
            for at in path:
                a, b = count.get(at, (0, 0))
                share = weighed(at)[1]
                p, rest = p + rest * share * (b + 0.5) / (a + b + 1), rest * (1 - share)
            lp += math.log10(p if bit else 1 - p)
        return lp

    return score


def test_text_scores_know_the_order_of_words(spark, monkeypatch):
    """Equal to the plain tree over whole texts; texts of the same words in another order score apart."""
    monkeypatch.setattr(context_tree, "BLOCK_GRAMS", 300)
    monkeypatch.setattr(context_tree, "CHUNK_BYTES", 200)
    rnd = random.Random(3)
    rows = [(i, t) for i, t in TEXTS if len(t or "") < 1000] + [(100 + i, " ".join(rnd.choice(["the", "theme", "Thesis", "a", "an", "and", "naïve"]) for _ in range(rnd.randrange(30)))) for i in range(30)]
    rows += [(200 + i, "salt and pepper") for i in range(20)] + [(300, "pepper and salt")]
    got = context_tree.text_scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    stream = lambda t: b"\xfe" + b" ".join(tokens(t))
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    score = whole_tree([stream(t) for i, t in rows if not held(i)], context_tree.DEPTH)
    want = sorted([(held(i), len(stream(t)) - 1, score(stream(t)), -1 if i is None else i) for i, t in rows], key=lambda r: (r[3], r[1], r[2]))
    got = sorted([(r.held_out, r.n_bytes, r.score, -1 if r.doc_id is None else r.doc_id, r.bits_per_byte) for r in got], key=lambda r: (r[3], r[1], r[2]))
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:2] == w[:2] and g[3] == w[3] and g[2] == pytest.approx(w[2], rel=1e-7, abs=1e-7)
        assert g[4] == pytest.approx(-w[2] / math.log10(2) / w[1], rel=1e-7)
    by_id = {g[3]: g[2] for g in got}
    assert by_id[300] < by_id[200] - 1
    assert context_tree.text_scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0
