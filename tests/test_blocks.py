"""Blocks of vectors and of texts: what a task holds, and results beside plain loops."""

import tracemalloc

import numpy as np
import pandas as pd

from plumbline.operators.matching import best_in_block


def test_scores_of_a_block_are_held_in_parts():
    rng = np.random.default_rng(1)
    x, y = rng.integers(-2, 3, (1500, 4)).astype(float), rng.integers(-2, 3, (4000, 4)).astype(float)  # many ties, some without direction
    asked, rows = pd.DataFrame({"asking": range(1500), "w": list(x)}), pd.DataFrame({"item": rng.permutation(4000), "u": list(y)})
    tracemalloc.start()
    got = best_in_block(6)(asked, rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 25_000_000  # all scores of the block are 48 MB
    ids = rows["item"].to_numpy()
    with np.errstate(invalid="ignore", divide="ignore"):
        c = (x @ y.T) / np.linalg.norm(x, axis=1)[:, None] / np.linalg.norm(y, axis=1)[None, :]
    for q in range(0, 1500, 50):
        order = [k for k in np.lexsort((ids, -np.nan_to_num(c[q], nan=-9)))[:6] if np.isfinite(c[q, k])]
        own = got[got["query_id"] == q]
        assert list(np.round(own["score"], 8)) == list(np.round(c[q, order], 8))
        assert set(own["item_id"][own["score"] > own["score"].min() + 1e-9]) <= set(ids[np.flatnonzero(c[q] > own["score"].min() + 1e-9)]) if len(own) else not order


def test_ratios_of_a_small_table_are_many_tasks(spark):
    from difflib import SequenceMatcher

    from pyspark.sql import functions as F

    from plumbline.operators.matching import text_ratio
    from plumbline.operators.review import feedback_boost

    texts = [None, "", "weld line 4", "weld line 5", "weld", "abc" * 90, "cab" * 90, "x"]
    rows = [(a, b) for a in texts for b in texts]
    got = spark.createDataFrame(rows, "a string, b string").coalesce(1).select("a", "b", text_ratio("a", "b").alias("r")).collect()
    assert {(r.a, r.b): r.r for r in got} == {(a, b): None if a is None or b is None else SequenceMatcher(None, a, b).ratio() for a, b in rows}
    asked = spark.range(400).coalesce(1).select(F.col("id").alias("event_id"), F.lit(1).alias("activity_id"), F.concat(F.lit("weld line "), "id").alias("text"))
    said = spark.createDataFrame([(1, "weld line 7", True)], "activity_id int, text string, approved boolean")
    tasks = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("boost", "")
    assert feedback_boost(asked, said).where("boost > 0").count() == 400
    stages = [tasks.getStageInfo(i) for j in tasks.getJobIdsForGroup("boost") for i in tasks.getJobInfo(j).stageIds]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert max(s.numTasks for s in stages if s) >= 4


def test_many_ratios_at_once_equal_those_of_pairs():
    """Random, templated, empty, other than ASCII, and so long that common characters are left out; most take one pass."""
    import random
    from difflib import SequenceMatcher

    from plumbline.operators.matching import matched_characters, text_ratio

    rnd = random.Random(4)
    word = lambda letters, most: "".join(rnd.choice(letters) for _ in range(rnd.randrange(most)))
    pairs = [(word(x, m), word(y, m)) for x, y in (("ab", "abc"), ("abcdef", "fedcba"), ("añ語𝄞\0\1", "ñ語a\0\1")) for m in (4, 30, 250) for _ in range(150)]
    pairs += [(f"erection of line {rnd.randrange(60)} at unit {k % 9}; {k % 40} of 40 joints", f"hydrotest of line {rnd.randrange(60)}, unit {k % 7}; {k % 90} spools") for k in range(2500)]
    pairs += [("b" * 1200 + "a", "a" + "b" * 20), ("abc" * 80, "cab" * 90), (None, "a"), ("a", None)]
    got = text_ratio.func(*[pd.Series(x, dtype=object) for x in zip(*pairs, strict=True)])
    want = [np.nan if a is None or b is None else SequenceMatcher(None, a, b).ratio() for a, b in pairs]
    assert np.array_equal(got.to_numpy(), want, equal_nan=True)
    assert list(matched_characters(["abxcd", "a"], ["abcd", "b"])) == [4, 0]


def _packed(sets, seed):
    from plumbline.operators import matching as M

    rng = np.random.default_rng(seed)
    rank = rng.permutation(M.BUCKETS).astype(np.int32)
    hashed = rng.integers(0, 2**32, 100_000).astype(np.uint32).view(np.int32)
    rank[hashed[:2000].astype(np.int64) % M.BUCKETS] = np.arange(2000) % 2000  # the first words are the common ones
    return pd.DataFrame({"set": range(len(sets)), "n": [len(x) for x in sets], "packed": M.packed_words(rank).func(pd.Series([hashed[np.sort(list(x))] for x in sets]))})


def test_sets_of_words_are_sent_packed():
    """Numbers come back in order, and common words take about a byte, where hashes took four."""
    from plumbline.operators.matching import packed_words, unpacked_words

    rng = np.random.default_rng(3)
    sets = [set(rng.integers(0, 2000, 600)) for _ in range(2100)] + [{7}, {99_999}, set(range(50_000))]
    table = _packed(sets, 1)
    word, held = unpacked_words(table["packed"].to_numpy())
    assert len(held) == len(sets) and (held <= table["n"]).all() and held.sum() > 0.98 * table["n"].sum() and (word >= 0).all()
    cuts = np.cumsum(held)[:-1]
    assert all((np.diff(x) > 0).all() for x in np.split(word, cuts)) and len({x.tobytes() for x in np.split(word, cuts)[:2100]}) == 2100
    assert sum(map(len, table["packed"][:2100])) < 1.6 * table["n"][:2100].sum()
    assert len(packed_words(np.arange(4, dtype=np.int32)).func(pd.Series([], dtype=object))) == 0


def test_large_sets_meet_in_blocks_as_in_a_plain_loop(monkeypatch):
    """Sets of thousands of words, too, in one block and in two, for several thresholds, with groups cut small; few are counted."""
    from plumbline.operators import matching as M

    rng = np.random.default_rng(5)
    base = [set(rng.choice(4000, int(rng.integers(1200, 2300)), replace=False)) for _ in range(60)] + [set(rng.choice(300, int(rng.integers(1, 60)))) for _ in range(60)]
    sets = base + [set(rng.choice(list(x), max(1, int(len(x) * share)), replace=False)) | set(rng.choice(9000, int(len(x) * 0.1))) for x in base for share in (0.55, 0.75, 0.95)]
    table = _packed(sets, 2)
    monkeypatch.setattr(M, "POSTINGS", 3000)
    monkeypatch.setattr(M, "TOGETHER", 50)
    for least in (0.5, 0.7, 1.0):
        run = M.alike_in_blocks(least, M.BUCKETS << M.FINER)
        alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= least  # noqa: B023, E731
        want = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if min(map(len, (sets[a], sets[b]))) >= least * max(map(len, (sets[a], sets[b]))) and alike(a, b)}
        got = [tuple(sorted(x)) for x in run(table.assign(side=0, own=True, own_cell=True)).itertuples(index=False)]
        assert len(got) == len(set(got)) and want <= set(got) and len(got) <= 1.1 * len(want) + 3
        half = table.assign(side=table["set"] % 2, own=False, own_cell=True)
        got = [tuple(sorted(x)) for x in run(half).itertuples(index=False)]
        across = {(a, b) for a, b in want if (a - b) % 2}
        assert len(got) == len(set(got)) and across <= set(got) and len(got) <= 1.1 * len(across) + 3
    assert run(table[:5].assign(side=0, own=False, own_cell=False)).empty
