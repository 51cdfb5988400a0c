"""Linking reports to planned activities: similarity, context boosts, routing, duplicates.

Texts are compared through TF-IDF weights on exploded tokens, joined by token, so that only pairs with a common token
meet; vectors are compared in blocks (see top_by_cosine). Candidates are cut to the best `keep` before context is
weighed, as the reference semantics ask.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType

from plumbline.functions import text as T
from plumbline.functions.numbers import containment, jaccard, rounded
from plumbline.functions.progress import AUTO, REVIEW, routed
from plumbline.operators.scan import scratch


SCORED = 64  # queries whose scores a task holds at a time
BLOCK_WORDS = 12_000_000  # words of the sets in a block, about: 20 MB as they are packed
BUCKETS, FINER = 1 << 18, 4  # of words, which are counted for their order, and bits that tell words of a bucket apart
BITS_A_WORD = 4  # of a bitmap
FLAGS, POSTINGS = 16_000_000, 2_000_000  # pairs of sets that are marked at a time, and entries of lists that are read for them
POPULAR, LONG, TOGETHER = 200, 1_000, 2_000  # characters of a second and a first text that many pairs are compared in, and how many pairs


def words(text: Column) -> Column:
    """Distinct words of ASCII letters and digits, in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1)))


def terms(text: Column) -> Column:
    """Words of two letters or more, in lower case, and then every two that follow each other."""
    w = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))
    pairs = F.zip_with(w, F.slice(w, 2, F.size(w)), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.concat(w, F.filter(pairs, lambda x: x.isNotNull()))


def tfidf(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, token, weight) of one- and two-word terms: smooth idf ln((1 + n) / (1 + df)) + 1, each document of length 1."""
    tokens = docs.select(F.col(id_col).alias("id"), F.explode(terms(F.col(text_col))).alias("token"))
    tf = tokens.groupBy("id", "token").agg(F.count("*").alias("tf"))
    n = docs.agg(F.count("*").alias("n"))
    df = tf.groupBy("token").agg(F.count("*").alias("df"))
    w = tf.join(df, "token").join(F.broadcast(n), how="cross")  # one row
    w = w.withColumn("w", F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    norm = w.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, "id").select("id", "token", (F.col("w") / F.col("norm")).alias("weight"))


def top_by_tfidf(queries: DataFrame, activities: DataFrame, keep: int = 10) -> DataFrame:
    """(query, activity_id, score): the best activities of each query among those that share a token with it."""
    q = queries.select(F.col("id").alias("query"), "token", F.col("weight").alias("qw"))
    a = activities.select(F.col("id").alias("activity_id"), "token", F.col("weight").alias("aw"))
    pairs = q.join(a, "token").groupBy("query", "activity_id").agg(F.sum(F.col("qw") * F.col("aw")).alias("score"))
    return first_by_score(pairs, keep)


def first_by_score(pairs: DataFrame, keep: int) -> DataFrame:
    """The best activities of each query, by scores of eight digits so that noise breaks no tie, then by id, with their rank."""
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc(rounded(F.col("score"), 8)), "activity_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= keep)


def best_in_block(keep: int):
    """Task code: of a block of queries (asking, w) and one of items (item, u), the items of highest cosine of each query."""

    def score(asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"query_id": [], "item_id": [], "score": []}
        if len(asked) and len(rows):
            y = np.vstack(rows["u"]).astype(float)
            ny, ids, names = np.linalg.norm(y, axis=1), rows["item"].to_numpy(), asked["asking"].to_numpy()
            for a in range(0, len(asked), SCORED):
                x = np.vstack(asked["w"].iloc[a : a + SCORED]).astype(float)
                nx = np.linalg.norm(x, axis=1)
                with np.errstate(invalid="ignore", divide="ignore"):
                    c = (x @ y.T) / nx[:, None] / ny[None, :]
                for row, name in enumerate(names[a : a + SCORED]):
                    own = np.where(np.isfinite(c[row]), c[row], -9)
                    # those that reach the last place kept, ties and all, are few: they alone are put in order
                    few = np.flatnonzero(own >= np.partition(own, -keep)[-keep]) if len(own) > keep else np.arange(len(own))
                    order = few[np.lexsort((ids[few], -own[few]))][:keep]
                    order = order[own[order] > -9]
                    out["query_id"] += [name] * len(order)
                    out["item_id"] += list(ids[order])
                    out["score"] += list(c[row, order])
        return pd.DataFrame(out)

    return score


def first_by_cosine(near: DataFrame, keep: int) -> DataFrame:
    """The best `keep` of each query among (query_id, item_id, score), ties of eight digits by id, with their rank."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(rounded(F.col("score"), 8)), "item_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= keep)


def top_by_cosine(queries: DataFrame, items: DataFrame, keep: int = 10, asked: int = 2_000, held: int = 20_000) -> DataFrame:
    """(query_id, item_id, score, rank): the items of highest cosine. queries and items: id, v array<float>.

    Queries and items are dealt by id to blocks of about `asked` and `held` rows; every two blocks meet in one task, which
    keeps the best of each query, so that what is shuffled is blocks and the best, never a pair of rows. Vectors without
    a direction take no part.
    """
    qn, n = -(-queries.count() // asked) or 1, max(8, -(-items.count() // held))
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    dealt = lambda k: F.pmod(F.xxhash64("id"), F.lit(k)).cast("int")
    q = queries.select(F.col("id").alias("asking"), F.col("v").alias("w"), dealt(qn).alias("qb"), every(n).alias("ib"))
    i = items.select(F.col("id").alias("item"), F.col("v").alias("u"), dealt(n).alias("ib"), every(qn).alias("qb"))

    near = q.groupBy("qb", "ib").cogroup(i.groupBy("qb", "ib")).applyInPandas(best_in_block(keep), "query_id long, item_id long, score double")
    return first_by_cosine(near, keep)


def boosts(event: dict[str, Column], activity: dict[str, Column], feedback: Column | None = None) -> Column:
    """What context adds to a similarity: identifier .20, discipline .15, location .10, WBS .05, dates .05 or .02,
    predecessors .05, .03 (none listed) or .02 (some done), and feedback."""
    found = T.identifiers(event["text"])
    named = F.exists(found, lambda x: F.upper(activity["name"]).contains(F.upper(x)))
    same = F.lower(event["discipline"]) == F.lower(activity["discipline"])
    place = F.contains(F.lower(activity["location"]), F.lower(event["location"]))
    tags = F.filter(found, lambda x: x.rlike(r"^[A-Za-z]+-\d+$"))
    wbs = F.exists(tags, lambda x: F.startswith(F.upper(activity["wbs_id"]), F.upper(F.substr(F.regexp_extract(x, "^([A-Za-z]+)", 1), F.lit(1), F.lit(3)))))
    preds, done = activity["predecessors"], event["completed"]
    yes = lambda test, x: F.when(F.coalesce(test, F.lit(False)), x).otherwise(0.0)
    total = yes(named, 0.20) + yes(same, 0.15) + yes(place, 0.10) + yes(wbs, 0.05)
    total = total + temporal_fit(event["date"], activity["planned_start"], activity["planned_finish"]) + dependency_fit(preds, done)
    return total + (feedback if feedback is not None else F.lit(0.0))


def temporal_fit(day: Column, start: Column, finish: Column) -> Column:
    """.05 within the planned days, .02 within a week of either end, else 0."""
    near = F.least(F.abs(F.datediff(day, start)), F.abs(F.datediff(day, finish))) <= 7
    return F.when(day.between(start, finish), 0.05).when(near, 0.02).otherwise(0.0)


def dependency_fit(predecessors: Column, completed: Column) -> Column:
    """.05 if all listed predecessors are done, .02 if some are, .03 if none are listed, else 0."""
    n, hit = F.size(predecessors), F.size(F.array_intersect(predecessors, completed))
    return F.when(predecessors.isNull() | (n == 0), 0.03).when(hit == n, 0.05).when(hit > 0, 0.02).otherwise(0.0)


def decided(ranked: DataFrame, text: Column, auto: float = AUTO, review: float = REVIEW) -> DataFrame:
    """The best candidate of each query (query, rank, score) with its lead over the second, and where it goes.

    Vague texts without an identifier whose two best are closer than .08 ask for clarification first."""
    lead = F.lead("score").over(Window.partitionBy("query").orderBy("rank"))
    top = ranked.withColumn("gap", F.col("score") - lead).where("rank = 1")
    unclear = T.is_vague(text) & (F.size(T.identifiers(text)) == 0) & F.coalesce(F.col("gap") < 0.08, F.lit(False))
    return top.withColumn("needs_clarification", unclear).withColumn("decision", F.when(unclear, "clarification_needed").otherwise(routed(F.col("score"), auto, review)))


def threshold_sweep(scored: DataFrame, pairs: list[tuple[float, float]]) -> DataFrame:
    """For each pair of thresholds: linked, wrongly linked, reviewed and unmatched of scored(score, correct boolean)."""
    t = scored.sparkSession.createDataFrame(pairs, "auto double, review double")
    link, seen = F.col("score") >= F.col("auto"), F.col("score") >= F.col("review")
    return scored.join(F.broadcast(t), how="cross").groupBy("auto", "review").agg(  # a few pairs of thresholds
        F.count_if(link).alias("linked"), F.count_if(link & ~F.col("correct")).alias("wrong"), F.count_if(~link & seen).alias("reviewed"), F.count_if(~seen).alias("unmatched")
    )


def _longest(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs of texts (a column of codes each): length of the longest piece in common, its first start in x, then in y."""
    size, pairs = y.shape
    run, more, same = np.zeros((size + 1, pairs), np.uint8), np.empty((size, pairs), np.uint8), np.empty((size, pairs), bool)
    best, end = np.zeros(pairs, np.uint8), np.zeros(pairs, np.int32)
    for i in range(len(x)):
        np.equal(y, x[i], out=same)
        np.add(run[:-1], 1, out=more)
        np.multiply(more, same.view(np.uint8), out=run[1:])  # how many end here alike
        top = run.max(0)
        end[top > best] = i + 1
        np.maximum(best, top, out=best)
    n = best.astype(np.int32)
    start, alike, each = end - n, np.ones((size, pairs), bool), np.arange(pairs)
    for k in range(int(n.max())):
        over = k >= n
        alike[: size - k] &= (y[k:] == x[np.minimum(start + k, len(x) - 1), each]) | over
        alike[size - k :] &= over
    return n, start, alike.argmax(0).astype(np.int32)


def _codes(text: str) -> np.ndarray:
    """A number for each character, none of them 0 or 1, in one byte where they fit."""
    if text.isascii():
        code = np.frombuffer(text.encode(), np.uint8)
        if not len(code) or code.min() > 1:
            return code
    code = np.unique(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), return_inverse=True)[1] + 2
    return code.astype(np.uint8 if code.max() < 256 else np.uint32)


def matched_characters(a: list[str], b: list[str]) -> np.ndarray:
    """Characters that two texts, not empty, match by Ratcliff and Obershelp, for many pairs at once: the longest piece in
    common, then the same before and behind it, step by step for all that is left of all pairs. Texts of b are shorter than
    POPULAR, from where on SequenceMatcher leaves out common characters."""
    la, lb = (np.fromiter(map(len, s), np.int32, len(s)) for s in (a, b))
    code, total, of = _codes("".join([*a, *b])), np.zeros(len(a), np.int64), np.arange(len(a), dtype=np.int32)
    last = len(code) - 1
    xs, ys = (np.cumsum(la) - la).astype(np.int32), (la.sum() + np.cumsum(lb) - lb).astype(np.int32)
    while len(of):
        order = np.lexsort((lb, la))  # pieces of one length lie together
        of, xs, la, ys, lb = (v[order] for v in (of, xs, la, ys, lb))
        found = []
        for s in (slice(k, k + TOGETHER) for k in range(0, len(of), TOGETHER)):
            i, j = np.arange(la[s].max(), dtype=np.int32)[:, None], np.arange(lb[s].max(), dtype=np.int32)[:, None]
            x = np.where(i < la[s], code[np.minimum(xs[s] + i, last)], code.dtype.type(0))
            y = np.where(j < lb[s], code[np.minimum(ys[s] + j, last)], code.dtype.type(1))
            found.append(_longest(x, y))
        n, p, q = map(np.concatenate, zip(*found, strict=True))
        np.add.at(total, of, n)
        r, t = la - p - n, lb - q - n
        before, behind = (n > 0) & (p > 0) & (q > 0), (n > 0) & (r > 0) & (t > 0)
        both = lambda u, v: np.concatenate([u[before], v[behind]])  # noqa: B023, E731
        of, xs, la, ys, lb = both(of, of), both(xs, xs + p + n), both(p, r), both(ys, ys + q + n), both(q, t)
    return total


@F.pandas_udf(DoubleType())
def text_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity of two texts, equal to SequenceMatcher(None, a, b).ratio(); null if either is."""
    from difflib import SequenceMatcher

    out, known = np.full(len(a), np.nan), {}
    first, second, many = a.to_numpy(), b.to_numpy(), []
    for i, (x, y) in enumerate(zip(first, second, strict=True)):
        if x is None or y is None:
            continue
        if x == y:
            out[i] = 1.0
        elif not x or not y:
            out[i] = 0.0
        elif len(y) < POPULAR and len(x) < LONG:
            many.append(i)
        else:
            m = known.get(y)
            if m is None:
                if len(known) >= 500:
                    known.clear()
                m = known[y] = SequenceMatcher(None, "", y)
            m.set_seq1(x)
            out[i] = m.ratio()
    if many:
        x, y = list(first[many]), list(second[many])
        out[many] = 2.0 * matched_characters(x, y) / (np.fromiter(map(len, x), np.int64) + np.fromiter(map(len, y), np.int64))
    return pd.Series(out)  # not a number: null


def spread(rows: DataFrame) -> DataFrame:
    """rows dealt evenly to all tasks: pairs of a small table would be compared in the few tasks that it was read in."""
    return rows.repartition(max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.sparkSession.sparkContext.defaultParallelism))


def packed_words(rank: np.ndarray):
    """Task code: hashes of a set's words as ascending numbers, rarer words by higher ones, in steps of seven bits a byte."""

    @F.pandas_udf(BinaryType())
    def pack(hs: pd.Series) -> pd.Series:
        if not len(hs):
            return pd.Series([], dtype=object)
        length = hs.str.len().to_numpy().astype(np.int64)
        h = np.concatenate(hs.to_numpy()).astype(np.int64) & 0xFFFFFFFF
        both = np.unique(np.repeat(np.arange(len(hs)), length) << 32 | rank[h % len(rank)].astype(np.int64) << FINER | h // len(rank) & (1 << FINER) - 1)
        of = both >> 32
        first = np.flatnonzero(np.diff(of, prepend=-1))
        step = np.diff(both & 0xFFFFFFFF, prepend=0)
        step[first] = both[first] & 0xFFFFFFFF
        size = 1 + sum((step >= 1 << 7 * k).astype(np.int64) for k in range(1, 4))
        end = np.cumsum(size)
        out = np.zeros(int(end[-1]), np.uint8)
        for k in range(4):
            more = size > k
            out[(end - size)[more] + k] = (step[more] >> 7 * k & 127) | np.where(size[more] > k + 1, 128, 0)
        cuts = [*(end - size)[first], len(out)]
        return pd.Series([out[a:z].tobytes() for a, z in zip(cuts, cuts[1:], strict=False)])

    return pack


def unpacked_words(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of packed sets one after the other, and how many each has."""
    words, held = [], []
    for a in range(0, len(packed), 2000):
        part = packed[a : a + 2000]
        data = np.frombuffer(b"".join(part), np.uint8)
        end = np.flatnonzero(data < 128)
        start = np.concatenate([[0], end[:-1] + 1])
        step = np.zeros(len(end), np.int64)
        for k in range(4):
            more = end - start >= k
            step[more] |= (data[start[more] + k] & 127).astype(np.int64) << 7 * k
        per = np.diff(np.searchsorted(end, np.cumsum([0, *map(len, part)])))
        total, first = np.cumsum(step), np.cumsum(per) - per
        words.append((total - np.repeat(total[first] - step[first], per)).astype(np.int32))
        held.append(per)
    return np.concatenate(words), np.concatenate(held)


def _ranges(low: np.ndarray, count: np.ndarray) -> np.ndarray:
    """low, low + 1, ... of each range, one after the other."""
    return np.repeat(low - np.cumsum(count) + count, count) + np.arange(int(count.sum()))


def alike_in_blocks(threshold: float, numbers: int):
    """Task code: of the sets (set, n, packed) of two blocks, side 0 and 1, or of one block, the pairs that can reach the threshold.

    Sets meet through their rarest words, of as many as the threshold leaves to the larger and to the smaller of two. What
    met is dropped by sizes and by bitmaps, as long as the sets need, in which each word turns a bit: two bitmaps differ in no
    more places than the sets do. What is left is counted. Words that share a number within a set only add to what is let through.
    """
    part = threshold / (1 + threshold)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        own, one_cell = bool(rows["own"].iloc[0]), bool(rows["own_cell"].iloc[0])
        rows = rows.iloc[np.argsort(rows["n"].to_numpy(), kind="stable")]  # of two, the later is the larger
        names, n, side = rows["set"].to_numpy(), rows["n"].to_numpy().astype(np.int64), rows["side"].to_numpy()
        first, second = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        none = pd.DataFrame({"a": names[:0], "b": names[:0]})
        if not len(first) or not (own or len(second)):
            return none
        word, held = unpacked_words(rows["packed"].to_numpy())
        del rows
        end = np.cumsum(held)
        start, lost = end - held, n - held  # lost: words that share a number with another of their set
        width = 1 << max(8, int(n.max() * BITS_A_WORD - 1).bit_length())
        bits = np.zeros((len(n), width // 64), np.uint64)
        for a in range(0, len(n), 2000):
            w = word[start[a] : end[min(a + 2000, len(n)) - 1]].astype(np.int64)
            turned = w * 0x9E3779B1 % (1 << 32) * width >> 32
            np.bitwise_xor.at(bits, (np.repeat(np.arange(a, min(a + 2000, len(n))), held[a : a + 2000]), turned >> 6), np.uint64(1) << (turned & 63).astype(np.uint64))
        reach = lambda share: np.maximum(np.minimum(n - np.ceil(n * share - 1e-9).astype(np.int64) + 1, held), 1)
        larger, smaller = reach(threshold), reach(2 * part)
        out_a, out_b, seen = [], [], np.zeros(numbers, bool)

        def meet(asking, listed):
            """Each of asking against the earlier ones of listed."""
            of = np.repeat(listed.astype(np.int32), smaller[listed])
            keyed = word[_ranges(end[listed] - smaller[listed], smaller[listed])]
            met = of[np.argsort(keyed, kind="stable")]
            after = np.cumsum(np.bincount(keyed, minlength=numbers))
            before = np.concatenate([[0], after[:-1]])
            del of, keyed
            a = 0
            while a < len(asking):
                group = asking[a : a + max(1, min(TOGETHER, FLAGS // (int(asking[min(a + TOGETHER, len(asking)) - 1]) + 1)))]
                asked = word[_ranges(end[group] - larger[group], larger[group])]
                hits = (after - before)[asked] if len(asked) > numbers else after[asked] - before[asked]
                each = np.cumsum(np.add.reduceat(hits, np.cumsum(larger[group]) - larger[group]))
                k = max(1, int(np.searchsorted(each, POSTINGS, side="right")))
                group, z = group[:k], int(larger[group[:k]].sum())
                to = met[_ranges(before[asked[:z]], hits[:z])]
                who = np.repeat(np.repeat(np.arange(len(group)), larger[group]), hits[:z])
                flags = np.zeros((len(group), int(group[-1]) + 1), bool)
                ok = to < flags.shape[1]
                flags[who[ok], to[ok]] = True
                del who, to, ok
                i, j = np.nonzero(flags)
                i = group[i]
                ok = j < i
                check(i[ok], j[ok])
                a += k

        def check(i, j):
            least = (n[i] + n[j]) * part - 1e-6 - np.minimum(lost[i], lost[j])
            ok = n[j] >= least
            i, j, least = i[ok], j[ok], least[ok]
            most, ok = held[i] + held[j] - 2 * least, np.zeros(len(i), bool)
            step = max(1, 1_000_000 // bits.shape[1])
            for a in range(0, len(i), step):
                s = slice(a, a + step)
                ok[s] = np.bitwise_count(bits[i[s]] ^ bits[j[s]]).sum(1, dtype=np.uint32) <= most[s]
            i, j, least = i[ok], j[ok], least[ok]
            cuts = [*np.flatnonzero(np.diff(i, prepend=-1)), len(i)]
            for a, z in zip(cuts, cuts[1:], strict=False):
                mine = word[start[i[a]] : end[i[a]]]
                seen[mine] = True
                for b in range(a, z, 1000):
                    c = j[b : min(b + 1000, z)]
                    common = np.add.reduceat(seen[word[_ranges(start[c], held[c])]], np.cumsum(held[c]) - held[c], dtype=np.int64)
                    alike = common + np.minimum(lost[i[a]], lost[c]) >= (n[i[a]] + n[c]) * part - 1e-6
                    out_a.append(np.repeat(names[i[a]], int(alike.sum())))
                    out_b.append(names[c[alike]])
                seen[mine] = False

        if own:
            meet(first, first)
        else:
            meet(second, first)
            if one_cell:
                meet(first, second)
        if not out_a:
            return none
        return pd.DataFrame({"a": np.concatenate(out_a).astype(names.dtype), "b": np.concatenate(out_b)})

    return run


def duplicate_pairs(items: DataFrame, threshold: float = 0.7, keys: tuple[str, ...] = ("discipline", "day")) -> DataFrame:
    """(a, b, similarity) of items(id, text, keys) that share the blocking keys and whose words overlap enough.

    Sets of words are dealt by keys and size to cells, in which sizes differ by less than the threshold, and cells to blocks of
    about BLOCK_WORDS words. A block meets those of its own cell and of the next one, two in a task (alike_in_blocks), so that
    pairs are never shuffled before they are known to be alike; those are verified by their words. Words are sent as numbers in
    the order of their frequency, which is that of BUCKETS of them, so that common ones take a byte. Items of one set of words
    are one in this, so that many copies do not pair with each other; each of their pairs is given at the end. A pair
    needs a common word; null keys meet none.
    """
    w = items.select("id", *keys, F.sort_array(words(F.col("text"))).alias("ws")).where(F.size("ws") > 0).dropna(subset=list(keys) or ["id"])
    w = scratch(w, "words")
    digest = F.sha2(F.concat_ws(" ", "ws"), 256).alias("digest")
    sets = w.groupBy(*keys, digest).agg(F.min("id").alias("set"))
    member = scratch(w.select("id", *keys, digest).join(sets, [*keys, "digest"]).select("set", "id"), "members")
    kind = dict(w.dtypes)["id"]
    size = F.size("ws")
    cell = F.floor(F.log(size.cast("double")) / F.lit(-np.log(threshold) if threshold < 1 else 1.0) + 1e-6).cast("int")
    counted = w.select(F.explode("ws").alias("x")).groupBy(F.pmod(F.hash("x"), F.lit(BUCKETS)).alias("x")).count().toArrow()
    rank, count = np.empty(BUCKETS, np.int32), np.zeros(BUCKETS, np.int64)
    count[counted["x"].to_numpy()] = counted["count"].to_numpy()
    rank[np.argsort(-count, kind="stable")] = np.arange(BUCKETS)
    one = w.join(member.where("set = id").select("id"), "id", "left_semi").select(F.col("id").alias("set"), *keys, size.alias("n"), cell.alias("cell"), packed_words(rank)(F.transform("ws", lambda x: F.hash(x))).alias("packed"))
    cells = scratch(w.groupBy(*keys, cell.alias("cell")).agg(F.ceil(F.sum(size) / BLOCK_WORDS).cast("int").alias("own_blocks")), "cells")
    after = cells.select(*keys, (F.col("cell") - 1).alias("cell"), F.col("own_blocks").alias("next_blocks"))
    before = cells.select(*keys, (F.col("cell") + 1).alias("cell"), F.col("own_blocks").alias("last_blocks"))
    by = [*keys, "cell"]
    dealt = one.join(scratch(cells.join(after, by, "left").join(before, by, "left"), "cells"), by).withColumn("block", F.pmod(F.xxhash64("set"), F.col("own_blocks")).cast("int"))
    to = lambda k, c, own, x, y, side: F.transform(F.sequence(F.lit(0), F.col(k) - 1), lambda j: F.struct(c.alias("c"), F.lit(own).alias("own_cell"), x(j).alias("x"), y(j).alias("y"), side(j).alias("side")))
    me, none = F.col("block"), F.array()
    tasks = F.concat(
        to("own_blocks", F.col("cell"), True, lambda j: F.least(me, j), lambda j: F.greatest(me, j), lambda j: F.when(me > j, 1).otherwise(0)),
        F.when(F.col("next_blocks").isNotNull(), to("next_blocks", F.col("cell"), False, lambda j: me, lambda j: j, lambda j: F.lit(0))).otherwise(none),
        F.when(F.col("last_blocks").isNotNull(), to("last_blocks", F.col("cell") - 1, False, lambda j: j, lambda j: me, lambda j: F.lit(1))).otherwise(none),
    )
    sent = dealt.select("set", "n", "packed", *keys, F.explode(tasks).alias("t")).select("set", "n", "packed", *keys, "t.*").withColumn("own", F.col("own_cell") & (F.col("x") == F.col("y")))
    met = scratch(sent.groupBy(*keys, "c", "own_cell", "x", "y").applyInPandas(alike_in_blocks(threshold, BUCKETS << FINER), f"a {kind}, b {kind}"), "met")
    few = w.join(met.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "id", "left_semi").select("id", "ws")
    both = met.join(few.select(F.col("id").alias("a"), F.col("ws").alias("wa")), "a").join(few.select(F.col("id").alias("b"), F.col("ws").alias("wb")), "b")
    common = both.select("a", "b", F.size("wa").alias("na"), F.size("wb").alias("nb"), F.size(F.array_intersect("wa", "wb")).alias("c"))
    sim = F.col("c").cast("double") / (F.col("na") + F.col("nb") - F.col("c"))
    near = common.where((F.col("c") > 0) & (sim >= threshold)).select("a", "b", rounded(sim, 3).alias("similarity"))
    alike = member.select(F.col("set").alias("a"), F.col("set").alias("b"), F.lit(1.0).alias("similarity")).distinct()
    first, second = member.select(F.col("set").alias("a"), F.col("id").alias("x")), member.select(F.col("set").alias("b"), F.col("id").alias("y"))
    # pairs of different sets in either order of ids, pairs within a set once
    out = near.join(first, "a").join(second, "b").unionByName(alike.join(first, "a").join(second, "b").where("x < y"))
    return out.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity")


def duplicate_groups(pairs: DataFrame) -> DataFrame:
    """Greedy groups: in order of ids, one not yet taken takes all later ones paired with it; (primary, duplicate, similarity).

    Rounds settle, for all primaries at once, those that no undecided earlier item could still take.
    """
    cut, taken = (lambda df: scratch(df, "groups")), None
    left = cut(pairs)
    while not left.isEmpty():
        # primaries: never the later item of an undecided pair
        first = left.select(F.col("a")).distinct().join(left.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
        won = cut(left.join(first, "a").groupBy("b").agg(F.min_by(F.struct("a", "similarity"), "a").alias("p")).select(F.col("p.a").alias("primary"), F.col("b").alias("duplicate"), F.col("p.similarity").alias("similarity")))
        taken = won if taken is None else taken.unionByName(won)
        gone = won.select(F.col("duplicate").alias("x")).unionByName(first.select(F.col("a").alias("x")))
        left = cut(left.join(gone.select(F.col("x").alias("a")), "a", "left_anti").join(gone.select(F.col("x").alias("b")), "b", "left_anti"))
    none = pairs.select(F.col("a").alias("primary"), F.col("b").alias("duplicate"), "similarity").limit(0)
    return taken if taken is not None else none


def replay_policy(steps: DataFrame, weights: list[float], rate: float = 0.05, low: float = 0.01, high: float = 5.0) -> list[float]:
    """Weights after the ordered steps (seq, reward, features): w += rate * reward * features, held to low..high.

    A run of steps is itself one step, w -> min(top, max(least, w + shift)): steps are dealt to ranges of seq, each range is
    folded where it lies, and only one such step a range comes back, to be applied in the order of the ranges.
    """
    n = len(weights)

    def fold(batches):
        first, shift = None, np.zeros(n)
        least, top = np.full(n, -np.inf), np.full(n, np.inf)
        for b in batches:
            for seq, reward, f in zip(b["seq"], b["reward"], b["features"], strict=True):
                first = seq if first is None else first
                move = rate * reward * np.asarray(f, float)
                shift = shift + move
                least, top = np.clip(least + move, low, high), np.clip(top + move, low, high)
        if first is not None:
            yield pd.DataFrame({"seq": [first], "shift": [shift], "least": [least], "top": [top]})

    dealt = steps.select("seq", "reward", "features").repartitionByRange("seq").sortWithinPartitions("seq")
    kind = dict(steps.dtypes)["seq"]
    runs = dealt.mapInPandas(fold, f"seq {kind}, shift array<double>, least array<double>, top array<double>")
    w = np.asarray(weights, float)
    for r in sorted(runs.collect(), key=lambda r: r.seq):  # one row a range
        w = np.minimum(r.top, np.maximum(r.least, w + np.asarray(r["shift"])))
    return [float(x) for x in w]


__all__ = ["words", "tfidf", "top_by_tfidf", "top_by_cosine", "boosts", "temporal_fit", "dependency_fit", "decided", "threshold_sweep", "text_ratio", "spread", "duplicate_pairs", "duplicate_groups", "replay_policy", "jaccard", "containment"]
