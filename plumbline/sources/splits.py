"""Elements of large XML and JSON files and records of XER files, read by splits: no file passes whole through a task.

A split is read as text, cut where its format often has a mark, and walked in order. A first walk folds each split to what it
does to the state (an element that is open, brackets, the table of a record); one row a split reaches the driver, which
tells what state each split begins in. A second walk gives the elements. One that runs over the end of a split is given in
parts, which are joined: an element may be longer than a split, but has to fit into a task.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.scan import scratch


class XmlTag:
    """Elements of one name, whatever their prefix, from an opening tag to the next closing one. State: whether one is open."""

    mark, leads = "</", True  # the mark begins a text
    begin = False

    def __init__(self, tag: str):
        self.opening, self.closing = rf"<(?:\w+:)?{tag}(?:\s[^>]*)?>", rf"</(?:\w+:)?{tag}>"

    def folding(self):
        event, last = re.compile(f"({self.opening})|{self.closing}"), None

        def feed(text: str) -> None:
            nonlocal last
            for m in event.finditer(text):
                last = m.group(1) is not None

        return feed, lambda: last

    def after(self, state: bool, last: bool | None) -> tuple[bool, bool]:
        """The state after a split, and whether what is open then began in it."""
        return (state, False) if last is None else (last, last)

    def walking(self, state: bool):
        opening, closing = re.compile(self.opening), re.compile(self.closing)
        rest, inside, began = [], state, False

        def feed(text: str) -> list[tuple[str, bool, bool]]:
            nonlocal inside, began
            out, pos = [], 0
            while (m := (closing if inside else opening).search(text, pos)) is not None:
                if inside:
                    out.append(("".join([*rest, text[pos : m.end()]]), began, True))
                    rest.clear()
                else:
                    rest.append(m.group())
                    began = True
                inside, pos = not inside, m.end()
            if inside:
                rest.append(text[pos:])
            return out

        return feed, lambda: [("".join(rest), began, False)] if inside else []


class JsonItems:
    """Objects of the list that a document is, or that it holds under `activities`. State: whether a string is open, and the
    open brackets, outermost first, A being that list's."""

    mark, leads = "}", False  # the mark ends a text
    begin = (False, "")
    string = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
    # a flat object at once, the list, a string, a bracket, or a quote whose string goes on
    token = rf'\{{[^"{{}}\[\]]*+(?:{string}[^"{{}}\[\]]*+)*+\}}|"activities"\s*:\s*\[|{string}|[\[\]{{}}]|"'

    def _tokens(self, quoted: bool):
        token, rest = re.compile(self.token, re.S), '"' if quoted else ""

        def feed(text: str):
            """(text, its matches, where it ends for now): what an open string has waits for more."""
            nonlocal rest
            text, found = rest + text, []
            end = len(text)
            for m in token.finditer(text):
                if m.group() == '"':
                    end = m.start()
                    break
                found.append(m)
            rest = text[end:]
            return text, found, end

        return feed, lambda: rest

    def folding(self):
        both = [(self._tokens(quoted), [0, ""]) for quoted in (False, True)]

        def feed(text: str) -> None:
            for (tokens, _), change in both:
                for m in tokens(text)[1]:
                    x = m.group()
                    if x in "[{":
                        change[1] += x
                    elif x in "]}":
                        if change[1]:
                            change[1] = change[1][:-1]
                        else:
                            change[0] += 1
                    elif x[0] == '"' and x[-1] == "[":
                        change[1] += "A"

        return feed, lambda: [(rest() != "", *change) for (_, rest), change in both]

    def after(self, state, fold):
        quoted, pops, pushed = fold[state[0]]
        kept = state[1][: max(0, len(state[1]) - pops)]
        return (quoted, kept + pushed), not _in_item(kept)

    def walking(self, state):
        (tokens, rest), stack = self._tokens(state[0]), state[1]
        parts, began, inside = [], False, _in_item(stack)
        virtual = int(state[0])  # the quote that the first text did not have

        def feed(text: str) -> list[tuple[str, bool, bool]]:
            nonlocal stack, began, inside, virtual
            text, found, end = tokens(text)
            out, start = [], 0
            for m in found:
                x = m.group()
                if x in "[{":
                    if x == "{" and stack in _LISTS:
                        inside, began, start = True, True, m.start()
                    stack += x
                elif x in "]}":
                    stack = stack[:-1]
                    if inside and stack in _LISTS:
                        out.append(("".join([*parts, text[start + (virtual if not start else 0) : m.end()]]), began, True))
                        parts.clear()
                        inside = False
                elif x[0] == "{":
                    if stack in _LISTS:
                        out.append((x, True, True))
                elif x[-1] == "[":
                    stack += "A"
            if inside and end > start:
                parts.append(text[start + (virtual if not start else 0) : end])
            if end:
                virtual = 0
            return out

        return feed, lambda: [("".join([*parts, rest()[virtual:]]), began, False)] if inside else []


_LISTS = ("[", "{A")


def _in_item(stack: str) -> bool:
    return any(stack.startswith(base + "{") for base in _LISTS)


def files(spark: SparkSession, path: str) -> DataFrame:
    """(h, file): the files of a path by the hash that splits know them by; nothing of them is read."""
    return spark.read.format("binaryFile").load(path).select(F.xxhash64("_metadata.file_path").alias("h"), F.col("_metadata.file_path").alias("file"))


def _pieces(spark: SparkSession, path: str, mark: str) -> DataFrame:
    m = "_metadata.file_"
    return spark.read.option("lineSep", mark).text(path).select(F.xxhash64(f"{m}path").alias("h"), F.col(f"{m}block_start").alias("block"), "value")


def runs(batches):
    """(h, block, values) of pieces, in order; those of one split follow each other."""
    for b in batches:
        h, block = b.column("h").to_numpy(), b.column("block").to_numpy()
        cuts = [0, *(np.flatnonzero((np.diff(h) != 0) | (np.diff(block) != 0)) + 1), b.num_rows]
        for a, z in zip(cuts, cuts[1:], strict=False):
            if z > a:
                yield int(h[a]), int(block[a]), b.column("value").slice(a, z - a)


def _texts(batches, mark: str, leads: bool):
    """(h, block, text): the text of pieces with their marks; nothing stands before the first of a file."""
    last = None
    for h, block, values in runs(batches):
        text = mark.join(values.to_pylist())
        whole_start = leads and block == 0 and (h, block) != last
        yield h, block, text + mark if not leads else text if whole_start else mark + text
        last = (h, block)


def begins(folds: list, begin, after: Callable) -> dict[tuple[int, int], tuple]:
    """The state that each split (h, block) begins in, and the block in which what is open then began."""
    out, of = {}, None
    for h, block, fold in sorted(folds, key=lambda r: r[:2]):
        if h != of:
            of, state, owner = h, begin, 0
        out[h, block] = (state, owner)
        state, here = after(state, fold)
        owner = block if here else owner
    return out


def elements(spark: SparkSession, path: str, kinds: dict[str, XmlTag | JsonItems], parse: dict[str, Callable[[Column], Column]]) -> dict[str, DataFrame]:
    """For each name of kinds (file, e): its elements in all files of a path, as parse gives them of an element's text.

    Kinds of one call have the same mark. Files are walked twice; what was parsed is stored."""
    first = next(iter(kinds.values()))
    mark, leads = first.mark, first.leads
    pieces = _pieces(spark, path, mark)

    def fold(batches):
        at, feeds = None, {}
        result = lambda: pa.RecordBatch.from_pydict({"h": [at[0]], "block": [at[1]], "fold": [json.dumps({k: end() for k, (_, end) in feeds.items()})]})
        for h, block, text in _texts(batches, mark, leads):
            if (h, block) != at:
                if at is not None:
                    yield result()
                at, feeds = (h, block), {k: kind.folding() for k, kind in kinds.items()}
            for feed, _ in feeds.values():
                feed(text)
        if at is not None:
            yield result()

    folds = [(r.h, r.block, json.loads(r.fold)) for r in pieces.mapInArrow(fold, "h long, block long, fold string").collect()]  # one row a split
    states = {k: begins([(h, b, f[k]) for h, b, f in folds], kind.begin, kind.after) for k, kind in kinds.items()}

    def walk(batches):
        at, feeds = None, {}

        def out(got, k):
            owner = states[k][at][1]
            n = len(got)
            return pa.RecordBatch.from_pydict(
                {
                    "h": pa.array([at[0]] * n, pa.int64()), "owner": pa.array([at[1] if began else owner for _, began, _ in got], pa.int64()), "block": pa.array([at[1]] * n, pa.int64()),
                    "kind": pa.array([k] * n, pa.string()), "ends": pa.array([e for _, _, e in got], pa.bool_()), "whole": pa.array([b and e for _, b, e in got], pa.bool_()), "x": pa.array([t for t, _, _ in got], pa.string()),
                }
            )

        for h, block, text in _texts(batches, mark, leads):
            if (h, block) != at:
                for k, (_, end) in feeds.items():
                    if got := end():
                        yield out(got, k)
                at = (h, block)
                if at not in next(iter(states.values())):
                    raise RuntimeError("files or their splits changed between two walks")
                feeds = {k: kind.walking(states[k][at][0]) for k, kind in kinds.items()}
            for k, (feed, _) in feeds.items():
                if got := feed(text):
                    yield out(got, k)
        for k, (_, end) in feeds.items():
            if got := end():
                yield out(got, k)

    found = pieces.mapInArrow(walk, "h long, owner long, block long, kind string, ends boolean, whole boolean, x string")
    own = {k: F.when(F.col("whole") & (F.col("kind") == k), parse[k](F.col("x"))).alias(f"e_{k}") for k in kinds}
    held = scratch(found.select("h", "owner", "block", "kind", "ends", "whole", F.when(~F.col("whole"), F.col("x")).alias("x"), *own.values()), "elements")
    parts = held.where("not whole").groupBy("h", "owner", "kind").agg(F.array_sort(F.collect_list(F.struct("block", "x"))).alias("xs"), F.bool_or("ends").alias("ends")).where("ends")  # an element's parts
    parts = parts.select("h", "kind", F.array_join("xs.x", "").alias("x"))
    named = F.broadcast(files(spark, path))
    out = {}
    for k in kinds:
        rows = held.where(f"whole and kind = '{k}'").select("h", F.col(f"e_{k}").alias("e")).unionByName(parts.where(f"kind = '{k}'").select("h", parse[k](F.col("x")).alias("e")))
        out[k] = rows.join(named, "h").select("file", "e")
    return out


def xer_tables(spark: SparkSession, path: str, wanted: dict[str, list[str]]) -> DataFrame:
    """(file, table, record array<string>): the records of some tables of P6 XER files, with the wanted fields of their table.

    %T names a table, %F its fields, %R is a record; empty values and missing fields are null."""
    m = "_metadata.file_"
    lines = spark.read.text(path).select(F.xxhash64(f"{m}path").alias("h"), F.col(f"{m}block_start").alias("block"), "value")
    tag = F.substring("value", 1, 3)

    def fold(batches):
        at, state = None, [None, None]
        result = lambda: pa.RecordBatch.from_pydict({"h": [at[0]], "block": [at[1]], "fold": [json.dumps(state)]})
        for h, block, values in runs(batches):
            if (h, block) != at:
                if at is not None:
                    yield result()
                at, state = (h, block), [None, None]
            for line in values.to_pylist():
                cells = line.rstrip("\r").split("\t")
                if cells[0] == "%T":
                    state[0] = cells[1] if len(cells) > 1 else state[0]
                elif cells[0] == "%F":
                    state[1] = cells[1:]
        if at is not None:
            yield result()

    heads = lines.where(tag.isin("%T\t", "%F\t")).mapInArrow(fold, "h long, block long, fold string")
    # splits without a head line are known by their number alone
    every = lines.groupBy("h", "block").agg(F.count("*").alias("n")).join(heads, ["h", "block"], "left")
    folds = [(r.h, r.block, json.loads(r.fold) if r.fold else [None, None]) for r in every.collect()]  # one row a split
    states = begins(folds, [None, None], lambda s, f: ([b if b is not None else a for a, b in zip(s, f, strict=True)], False))

    def walk(batches):
        at = table = fields = places = None
        for h, block, values in runs(batches):
            if (h, block) != at:
                at = (h, block)
                if at not in states:
                    raise RuntimeError("files or their splits changed between two walks")
                (table, fields), places = states[at][0], None
            tables, records = [], []
            for line in values.to_pylist():
                cells = line.rstrip("\r").split("\t")
                if cells[0] == "%R":
                    if table not in wanted or fields is None:
                        continue
                    if places is None:
                        places = [fields.index(f) + 1 if f in fields else None for f in wanted[table]]
                    n = len(cells)
                    tables.append(table)
                    records.append([cells[p] or None if p is not None and p < n else None for p in places])
                elif cells[0] == "%T":
                    table, places = cells[1] if len(cells) > 1 else table, None
                elif cells[0] == "%F":
                    fields, places = cells[1:], None
            if tables:
                yield pa.RecordBatch.from_pydict({"h": pa.array([at[0]] * len(tables), pa.int64()), "table": pa.array(tables, pa.string()), "record": pa.array(records, pa.list_(pa.string()))})

    got = lines.where(tag.isin("%T\t", "%F\t", "%R\t")).mapInArrow(walk, "h long, table string, record array<string>")
    return got.join(F.broadcast(files(spark, path)), "h").select("file", "table", "record")
