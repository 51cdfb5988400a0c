"""N-gram Jaccard join: light sets meet by enumerated subsets, heavy ones by inverted lists, the boundary set by cost.

Every text is a set of hashed word shingles; equal sets are one node. Two sets link when percent * union <= 100 *
intersection. Candidates come from three sources, none of which misses a link:

* Two light sets link if and only if they share a subset of the size that their link needs. Each light set writes the
  signatures of its subsets of such sizes, and under one signature the smallest set links to all it can: a star, not all
  pairs. Which sizes are light follows from the counted cost of subsets against that of lists.
* Other pairs meet in inverted lists. All elements stand in one order, rare ones first as far as a table of counts of a
  fixed size tells; any order is right, this one keeps common passages out of the lists. Each set posts its first
  n - ceil(percent * n / 100) + 1 elements with their places: of two linked sets, the first common element is posted by
  both, and as many elements as the link needs follow it in both ("room").
* A list of two sets is one pair. In longer ones, sets of about one size meet one hub, the set with the fewest elements before the list's own, so that the
  lists of a group of copies agree on it. The links found contract sets into groups. Lists whose sets are of several
  groups meet their next hubs, and then groups are compared by size and least place: members of two groups are listed
  only where these bounds leave room for a link. Copies of copies thus never meet pair by pair.

Candidates whose odd sketches differ in more bits than linked sets can in elements are dropped, which is exact, and the
rest is verified on the whole sets. Links lead to components by stars on stored tables. Counts and lists cover all
documents; nothing is capped, sampled or gathered but the table of counts.
"""

from __future__ import annotations

import zlib
from itertools import combinations
from math import comb, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shared import components, discard, stored, text_or_empty
from plumbline.llm.shingles import mix, odd_sketch, set_hashes, shingle_sets

LIGHT = 19  # no set of more elements is light
SUBSETS = 1000  # nor one of more subsets
BROADCAST = 200_000  # names of sets that are broadcast, at most; more are joined by a shuffle
WIDE = 1000  # elements from which a set has a sketch of 8192 bits too
COUNTERS = 23  # 2**COUNTERS counters of elements: 8 MB are broadcast, whatever the input
STARS = 3  # rounds of hubs, at most, before groups are compared
_BLOCK = 16  # 2**_BLOCK counters travel together
_ROWS = 256  # texts hashed at a time


def needed(n: int, m: int, percent: int) -> int:
    """Common elements that sets of n and m elements need for a link."""
    return -(-percent * (n + m) // (100 + percent))


def prefix(n: int, percent: int) -> int:
    return n + 1 - -(-percent * n // 100)


def subset_count(n: int, percent: int) -> int:
    return sum(comb(n, c) for c in range(-(-percent * n // 100), n + 1))


def _sets(batches, width: int, column: str = "t"):
    for b in batches:
        for a in range(0, b.num_rows, _ROWS):
            part = b.slice(a, _ROWS)
            yield part, shingle_sets(part.column(column).to_pylist(), width)


def element_levels(docs: DataFrame, width: int) -> np.ndarray:
    """How frequent the elements of each of 2**COUNTERS hash classes are over all rows, as a level of 0 to 255 (eight to a
    doubling). Tasks count into arrays, whose blocks are added after a shuffle; 8 MB reach the driver."""
    size = 1 << _BLOCK

    def count(batches):
        acc, one = np.zeros(1 << COUNTERS, np.uint32), np.uint32(1)
        for _, sets in _sets(batches, width):
            np.add.at(acc, (np.concatenate(sets) >> np.uint64(64 - COUNTERS)).astype(np.int64), one)
        for k, block in enumerate(acc.reshape(-1, size)):
            if block.any():  # planes of bytes deflate better than whole numbers
                data = zlib.compress(block.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)
                yield pa.RecordBatch.from_pydict({"block": [k], "counts": [data]}, schema=pa.schema([("block", pa.int32()), ("counts", pa.binary())]))

    def add(batches):
        block, acc = None, None
        schema = pa.schema([("block", pa.int32()), ("levels", pa.binary())])

        def out():
            level = np.minimum(255, 8 * np.log2(1.0 + acc)).astype(np.uint8)
            return pa.RecordBatch.from_pydict({"block": [block], "levels": [level.tobytes()]}, schema=schema)

        for b in batches:
            for k, data in zip(b.column("block").to_pylist(), b.column("counts").to_pylist(), strict=True):
                if k != block:
                    if block is not None:
                        yield out()
                    block, acc = k, np.zeros(size)
                acc += np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1).T.copy().view(np.uint32).ravel()
        if block is not None:
            yield out()

    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = docs.select("t").mapInArrow(count, "block int, counts binary").repartition(n, "block").sortWithinPartitions("block")
    levels = np.zeros(1 << COUNTERS, np.uint8)
    for r in parts.mapInArrow(add, "block int, levels binary").collect():  # 128 rows
        levels[r.block * size : (r.block + 1) * size] = np.frombuffer(r.levels, np.uint8)
    return levels


def in_order(s: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The elements of an ascending set, rare ones first; the order of two elements is the same in every set."""
    rank = levels[(s >> np.uint64(64 - COUNTERS)).astype(np.int64)]
    return s[np.argsort(rank, kind="stable")]


def set_table(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(id, x, n, h1, h2, sketch, wide, few, post): hash of each row's text; size, 128-bit name and sketch of its set; wide: a
    larger sketch of large sets; few: the elements of small ones; post: the elements that it posts, in order."""
    levels = docs.sparkSession.sparkContext.broadcast(element_levels(docs, width))

    def run(batches):
        for part, sets in _sets(batches, width):
            names = [set_hashes(s) if len(s) else (0, 0) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("id"),
                    part.column("x"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([x[0] for x in names], pa.int64()),
                    pa.array([x[1] for x in names], pa.int64()),
                    pa.array([odd_sketch(s) if len(s) else None for s in sets], pa.list_(pa.int64())),
                    pa.array([odd_sketch(s, 13) if len(s) >= WIDE else None for s in sets], pa.list_(pa.int64())),
                    pa.array([s.view(np.int64) if 0 < len(s) <= LIGHT else None for s in sets], pa.list_(pa.int64())),
                    pa.array([in_order(s, levels.value)[: prefix(len(s), percent)].view(np.int64) if len(s) else None for s in sets], pa.list_(pa.int64())),
                ],
                names=["id", "x", "n", "h1", "h2", "sketch", "wide", "few", "post"],
            )

    kind = dict(docs.dtypes)["id"]
    return docs.select("id", "t", F.xxhash64("t").alias("x")).mapInArrow(run, f"id {kind}, x long, n long, h1 long, h2 long, sketch array<long>, wide array<long>, few array<long>, post array<long>")


def set_texts(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(sid, h2, t): a text for each set that wanted(sid, x) names, x being the hash of such a text; only texts of these
    hashes are read into sets, and they cross the network once."""

    def name(batches):
        seen: set[int] = set()
        for part, sets in _sets(batches, width):
            keep, names = [], []
            for i, s in enumerate(sets):
                if len(s) and (both := set_hashes(s)) not in seen:  # copies in a task pass once, as far as it remembers
                    if len(seen) < 1_000_000:
                        seen.add(both)
                    keep.append(i)
                    names.append(both)
            arrays = [pa.array([x[k] for x in names], pa.int64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*arrays, part.column("t").take(pa.array(keep, pa.int64()))], names=["sid", "h2", "t"])

    hashes = wanted.select("x").distinct()
    if wanted.count() <= BROADCAST:
        wanted, hashes = F.broadcast(wanted), F.broadcast(hashes)
    named = docs.select("t", F.xxhash64("t").alias("x")).join(hashes, "x", "left_semi").select("t").mapInArrow(name, "sid long, h2 long, t string")
    # equal sets of different tasks: any of their texts
    return named.join(wanted.select("sid").distinct(), "sid").groupBy("sid", "h2").agg(F.first("t").alias("t"))


def verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (x, y) of names whose whole sets link, as (a, b) of structs h1, h2. y is the side that repeats."""

    def check(batches):
        last, ys = None, None
        for b in batches:
            for a in range(0, b.num_rows, _ROWS):
                part = b.slice(a, _ROWS)
                keep = []
                names = zip(part.column("y").to_pylist(), part.column("y2").to_pylist(), strict=True)
                for i, (name, xs) in enumerate(zip(names, shingle_sets(part.column("tx").to_pylist(), width), strict=True)):
                    if name != last:  # rows of one y follow each other
                        last, ys = name, shingle_sets([part.column("ty")[i].as_py()], width)[0]
                    c = len(np.intersect1d(xs, ys, assume_unique=True))
                    if 100 * c >= percent * (len(xs) + len(ys) - c):
                        keep.append(i)
                yield part.select(["x", "x2", "y", "y2"]).take(pa.array(keep, pa.int64()))

    left = texts.select(F.col("sid").alias("x"), F.col("h2").alias("x2"), F.col("t").alias("tx"))
    right = texts.select(F.col("sid").alias("y"), F.col("h2").alias("y2"), F.col("t").alias("ty"))
    met = pairs.select("x", "y").join(left, "x").join(right, "y").select("x", "x2", "tx", "y", "y2", "ty")
    met = met.mapInArrow(check, "x long, x2 long, y long, y2 long")
    return met.select(F.struct(F.col("x").alias("h1"), F.col("x2").alias("h2")).alias("a"), F.struct(F.col("y").alias("h1"), F.col("y2").alias("h2")).alias("b"))


def light_links(light: DataFrame, percent: int) -> DataFrame:
    """(a, b) among light sets (sid, few): under each subset signature, the smallest set with all it can link to."""

    def run(batches):
        for b in batches:
            sigs, sids, sizes, cs = [], [], [], []
            for sid, few in zip(b.column("sid").to_pylist(), b.column("few").to_pylist(), strict=True):
                m = mix(np.array(few, np.int64).view(np.uint64))
                total, n = m.sum(dtype=np.uint64), len(few)
                for gone in range(n - -(-percent * n // 100) + 1):
                    at = np.array(list(combinations(range(n), gone)), np.int64).reshape(comb(n, gone), gone)
                    with np.errstate(over="ignore"):
                        sig = mix(total - m[at].sum(1, dtype=np.uint64) + np.uint64(n - gone))
                    sigs.append(sig.view(np.int64))
                    for out, v in ((sids, sid), (sizes, n), (cs, n - gone)):
                        out.append(np.full(len(sig), v))
            if sigs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (sigs, sids, sizes, cs)], names=["sig", "sid", "size", "c"])

    subsets = light.select("sid", "few").mapInArrow(run, "sig long, sid long, size long, c long")
    least = stored(subsets.groupBy("sig", "c").agg(F.min(F.struct("size", "sid")).alias("m"), F.count("*").alias("k")).where("k > 1"), "jaccard-subsets")
    met = subsets.join(least, ["sig", "c"])
    # with c common elements, sizes n and m link when (100 + percent) * c >= percent * (n + m)
    met = met.where(f"sid <> m.sid and {100 + percent} * c >= {percent} * (size + m.size)")
    return met.select(F.least("sid", "m.sid").alias("a"), F.greatest("sid", "m.sid").alias("b")).distinct()


class _Links:
    """Pairs tried so far, and the links among them."""

    def __init__(self, base: DataFrame, nodes: DataFrame, width: int, percent: int):
        self.base, self.nodes, self.width, self.percent = base, nodes, width, percent
        self.tried, self.texts, self.links, self.found = [], [], [], False

    def test(self, pairs: DataFrame) -> None:
        """Adds the links among pairs(x, y), of which those that sizes and sketches exclude, or that were tried, fall away."""
        p = self.percent
        mark = self.nodes.select("sid", F.struct("n", "sketch", "wide").alias("s"))
        both = pairs.join(mark.select(F.col("sid").alias("x"), F.col("s").alias("sx")), "x").join(mark.select(F.col("sid").alias("y"), F.col("s").alias("sy")), "y")
        likely = both.where(_may_link(p).replace("a.", "sx.").replace("b.", "sy.")).select("x", "y").distinct()
        for old in self.tried:
            either = old.unionByName(old.select(F.col("y").alias("x"), F.col("x").alias("y")))
            likely = likely.join(either, ["x", "y"], "left_anti")
        likely = stored(likely, "jaccard-likely")
        self.found = not likely.isEmpty()
        if not self.found:
            discard(likely)
            return
        wanted = likely.select(F.col("x").alias("sid")).unionByName(likely.select(F.col("y").alias("sid"))).distinct()
        for old in self.texts:
            wanted = wanted.join(old.select("sid"), "sid", "left_anti")
        wanted = stored(wanted.join(self.nodes.select("sid", "x"), "sid"), "jaccard-wanted")
        self.texts.append(stored(set_texts(self.base, wanted, self.width), "jaccard-texts"))
        discard(wanted)
        texts = self.texts[0]
        for more in self.texts[1:]:
            texts = texts.unionByName(more)
        links = stored(verified(likely, texts, self.width, p), "jaccard-links")
        self.tried.append(likely)
        self.links.append(links)
        self.found = not links.isEmpty()

    def groups(self) -> DataFrame | None:
        """(node, component) of all nodes that have a link."""
        if not self.links:
            return None
        links = self.links[0]
        for more in self.links[1:]:
            links = links.unionByName(more)
        return stored(components(links), "jaccard-groups")


def _may_link(percent: int) -> str:
    """SQL over rows a and b with n and sketch: sizes and sketches allow a link."""
    n = "(a.n + b.n)"
    need = f"({percent} * {n} + {99 + percent}) div {100 + percent}"
    wide = f"aggregate(zip_with(a.wide, b.wide, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x) <= {n} - 2 * ({need})"
    bits = " + ".join(f"bit_count(a.sketch[{i}] ^ b.sketch[{i}])" for i in range(8))
    return f"{percent} * greatest(a.n, b.n) <= 100 * least(a.n, b.n) and {bits} <= {n} - 2 * ({need}) and coalesce({wide}, true)"


def _room(percent: int, light: int) -> str:
    """SQL over rows a and b with n and pos: a link may have its first common element at these places; not both are light."""
    need = f"({percent} * (a.n + b.n) + {99 + percent}) div {100 + percent}"
    return f"{percent} * greatest(a.n, b.n) <= 100 * least(a.n, b.n) and least(a.n - a.pos, b.n - b.pos) >= {need} and not (a.n <= {light} and b.n <= {light})"


def _light_bound(nodes: DataFrame, met: DataFrame, percent: int) -> int:
    """Sizes up to this are light: the boundary of least cost, from the counted cost of each size."""
    few = nodes.where(F.col("n") <= LIGHT).groupBy("n").agg(F.count("*").alias("sets")).collect()  # at most LIGHT rows
    lists = met.groupBy("tok").agg(F.count("*").alias("k"))
    scans = dict(met.where(F.col("n") <= LIGHT).groupBy("tok", "n").agg(F.count("*").alias("c")).join(lists, "tok").groupBy("n").agg(F.sum(F.col("c") * F.col("k"))).collect())
    light, spent, best = 0, 0, 0
    for n, count in sorted((r.n, r.sets) for r in few):
        if subset_count(n, percent) > SUBSETS:
            break
        spent += count * subset_count(n, percent) - (scans.get(n) or 0)
        if spent <= best:
            light, best = n, spent
    return light


def _stars(rows: DataFrame, room: str) -> tuple[DataFrame, DataFrame]:
    """(pairs x, y of rows(tok, class, sid, n, pos) with the hub of their list and a neighbouring size class, hubs)."""
    hubs = stored(rows.groupBy("tok", "class").agg(F.min(F.struct("pos", "sid", "n")).alias("m")).select("tok", "class", "m.sid", "m.n", "m.pos"), "jaccard-hubs")
    pairs = _reaching(rows).alias("a").join(hubs.alias("b"), ["tok", "class"]).where(f"a.sid <> b.sid and {room}")
    return pairs.select(F.col("a.sid").alias("x"), F.col("b.sid").alias("y")).distinct(), hubs


def _reaching(rows: DataFrame) -> DataFrame:
    """rows once for each size class that linked sets can be of."""
    return rows.withColumn("class", F.explode(F.array(F.col("class") - 1, F.col("class"), F.col("class") + 1)))


def _open(rows: DataFrame, grouped: DataFrame) -> DataFrame:
    """rows(tok, class, sid, n, pos) with their groups g, of lists that hold several groups."""
    members = stored(rows.drop("g").join(grouped.select("sid", "g"), "sid"), "jaccard-members")
    several = stored(members.groupBy("tok").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo <> hi").select("tok"), "jaccard-several")
    out = stored(members.join(several, "tok"), "jaccard-open")
    discard(members, several)
    return out


def _between_groups(rows: DataFrame, room: str) -> DataFrame:
    """(x, y) of rows(tok, class, sid, n, pos, g) of one list and different groups. Groups meet first, by size and least
    place; their members are listed only where a pair can have room."""
    kinds = stored(rows.groupBy("tok", "class", "g", "n").agg(F.min("pos").alias("pos")), "jaccard-kinds")
    met = _reaching(kinds).alias("a").join(kinds.alias("b"), ["tok", "class"]).where(f"a.g < b.g and {room}")
    met = stored(met.select("tok", F.struct("a.g", "a.n").alias("ka"), F.struct("b.g", "b.n").alias("kb")), "jaccard-kinds")
    some = stored(met.select("tok", F.col("ka").alias("k")).unionByName(met.select("tok", F.col("kb").alias("k"))).distinct(), "jaccard-kinds")
    member = stored(rows.withColumn("k", F.struct("g", "n")).join(some, ["tok", "k"]).select("tok", "k", "sid", "n", "pos"), "jaccard-members")
    one = member.select("tok", F.col("k").alias("ka"), F.struct("sid", "n", "pos").alias("a"))
    two = member.select("tok", F.col("k").alias("kb"), F.struct("sid", "n", "pos").alias("b"))
    return one.join(met, ["tok", "ka"]).join(two, ["tok", "kb"]).where(room).select(F.col("a.sid").alias("x"), F.col("b.sid").alias("y")).distinct()


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id: the smallest id that links reach, its own included.

    Links: see above. A null or empty text, or one of blanks, has no shingles and links with nothing. Copies, and rows
    that repeat an id, share a component. Null ids are passed over when the smallest is sought; a component of null
    ids alone has null. An empty table gives no rows; other columns are ignored. percent is a whole number, 50 to 100.
    """
    table, groups = _grouped(docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("t")), width, percent)
    placed = stored(_placed(table, groups), "jaccard-placed")
    least = stored(placed.groupBy("g").agg(F.min("id").alias("component_id")), "jaccard-least")
    out = placed.join(least, "g").select("id", "n", "component_id")
    out = out.unionByName(table.where("n = 0").select("id", "n", F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def _placed(table: DataFrame, groups: DataFrame | None) -> DataFrame:
    """The rows of table that have elements, with the group g of their set."""
    rows = table.where("n > 0").select(*[c for c in table.columns if c in ("id", "n")], F.struct("h1", "h2").alias("node"))
    if groups is None:
        return rows.withColumnRenamed("node", "g")
    return rows.join(groups, "node", "left").withColumn("g", F.coalesce("component", "node")).drop("node", "component")


def _grouped(base: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame | None]:
    """set_table of base(id, t), stored, and (node, component) of its linked nodes (None: there is no link)."""
    table = stored(set_table(base, width, percent), "jaccard-sets")
    nodes = table.where("n > 0").groupBy("h1", "h2").agg(F.min("x").alias("x"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("wide").alias("wide"), F.first("few").alias("few"))
    nodes = stored(nodes, "jaccard-nodes").withColumn("sid", F.col("h1"))
    # inverted lists of two sets or more
    post = table.where("n > 0").select(F.col("h1").alias("sid"), "n", F.posexplode("post").alias("pos", "tok"))
    ends = post.groupBy("tok").agg(F.min(F.struct("sid", "n", "pos")).alias("a"), F.max(F.struct("sid", "n", "pos")).alias("b"), F.count("*").alias("k"))
    shared = stored(ends.where(f"a.sid < b.sid and (k > 2 or {_room(percent, 0)})"), "jaccard-shared")
    raw = stored(post.join(shared.where("k > 2").select("tok"), "tok"), "jaccard-met")  # copies post alike
    size_class = F.floor(F.log("n") / F.lit(log(100 / percent) + 1e-9)).cast("int") if percent < 100 else F.col("n").cast("int")
    met = stored(raw.groupBy("tok", "sid").agg(F.first("n").alias("n"), F.first("pos").alias("pos")).withColumn("class", size_class), "jaccard-lists")
    discard(raw)
    light = _light_bound(nodes, met, percent)
    room, work = _room(percent, light), _Links(base, nodes, width, percent)
    pairs, hubs = _stars(met, room)
    pairs = pairs.unionByName(shared.where(f"k = 2 and {room}").select(F.col("a.sid").alias("x"), F.col("b.sid").alias("y")))
    if light:
        few = light_links(nodes.where((F.col("n") <= light) & F.col("few").isNotNull()), percent)
        pairs = pairs.unionByName(few.select(F.col("a").alias("x"), F.col("b").alias("y")))
    work.test(pairs.distinct())
    discard(shared)
    groups, rows = work.groups(), met
    for again in range(STARS):
        own = F.struct(F.col("sid").alias("h1"), F.col("h2"))
        grouped = nodes.select("sid", own.alias("g"))
        if groups is not None:
            grouped = nodes.select("sid", own.alias("node")).join(groups, "node", "left").select("sid", F.coalesce("component", "node").alias("g"))
        grouped = stored(grouped, "jaccard-grouped")
        before, rows = rows, _open(rows, grouped)
        discard(before, grouped)
        if rows.isEmpty() or again == STARS - 1:
            break
        # the next hubs: sets outside the groups of those before
        tops = stored(hubs.select("tok", "class", "sid").join(rows.select("tok", "sid", "g"), ["tok", "sid"]).select("tok", "class", "g").distinct(), "jaccard-tops")
        rest = stored(rows.join(tops, ["tok", "class", "g"], "left_anti"), "jaccard-rest")
        pairs, more = _stars(rest, room)
        work.test(pairs)
        discard(rest, tops)
        hubs = hubs.unionByName(more)
        if not work.found:
            break
        groups = work.groups()
    if not rows.isEmpty():
        work.test(_between_groups(rows, room))
        if work.found:
            groups = work.groups()
    discard(rows, *work.texts, *work.tried)
    return table, groups


def drop_near_copies(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component: that of the smallest id, and of rows that repeat it, that of the smallest text.

    Rows without shingles (null, empty or blank texts) stay, each of them, and so do rows of null ids. Rows that repeat
    both id and text are told apart by nothing: one of them stays. All columns of docs are kept, whatever their names.
    """
    digest = F.unhex(F.md5(text_or_empty(text_col)))
    table, groups = _grouped(docs.select(F.struct(F.col(id_col).alias("id"), digest.alias("d")).alias("id"), text_or_empty(text_col).alias("t")), width, percent)
    placed = stored(_placed(table, groups).where("id.id is not null"), "jaccard-placed")
    least = stored(placed.groupBy("g").agg(F.min("id").alias("least")), "jaccard-least")
    marked = placed.join(least, "g").groupBy("id").agg((F.first("id") == F.min("least")).alias("stays"), F.count("*").alias("rows"))
    marked = stored(marked.where("not stays or rows > 1").select("id.*", "stays"), "jaccard-gone")
    gone, twice = marked.where("not stays"), marked.where("stays")
    if marked.count() <= BROADCAST:
        gone, twice = F.broadcast(gone), F.broadcast(twice)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), digest.alias("d"))
    out = packed.join(gone, ["id", "d"], "left_anti")
    if not marked.where("stays").isEmpty():  # rows that repeat both id and text
        out = out.join(twice, ["id", "d"], "left_anti").unionByName(out.join(twice, ["id", "d"], "left_semi").dropDuplicates(["id", "d"]))
    return out.select("row.*")
