"""Schedules read by splits: elements and records that run over the ends of splits, and documents of one line."""

import json

import pytest
from pyspark.sql import functions as F

from plumbline.sources import schedules
from plumbline.sources.splits import JsonItems, XmlTag, elements


@pytest.fixture(params=[300, 10_000_000])
def split(spark, request):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(request.param))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield request.param
    for k, v in before.items():
        spark.conf.set(k, v)


def ids(df):
    return sorted((r.activity_id, r.activity_name) for r in df.select("activity_id", "activity_name").collect())


@pytest.mark.parametrize("layout", [None, 1])
@pytest.mark.parametrize("bare", [True, False])
def test_json(spark, tmp_path, split, layout, bare):
    names = [f"No. {i} }} ]{{ \"said\" \\ {'é' * (i % 40)}" for i in range(40)]
    items = [{"id": f"A{i}", "name": n, "more": {"x": [{"activities": [1, {"id": "no"}]}]} if i % 3 else "{", "predecessors": ["A1"] if i % 2 else "A1, A2"} for i, n in enumerate(names)]
    for f, part in (("a", items[:25]), ("b", items[25:])):
        doc = part if bare else {"project": {"id": "P", "x": ["}", {"y": 1}]}, "activities": part, "last": [{"id": "no"}]}
        (tmp_path / f"{f}.json").write_text(json.dumps(doc, indent=layout, ensure_ascii=False))
    got = schedules.read_schedule(spark, str(tmp_path))
    assert ids(got) == sorted((f"A{i}", n) for i, n in enumerate(names))
    assert {tuple(r[0]) for r in got.select("predecessors").collect()} == {("A1",), ("A1", "A2")}
    assert got.select("source_file").distinct().count() == 2


@pytest.mark.parametrize("prefix", ["", "p:"])
def test_xml(spark, tmp_path, split, prefix):
    p = prefix
    acts = [f"<{p}Activity><{p}Id>C{i}</{p}Id><{p}Name>{'n' * (i % 70 + 1)}</{p}Name><{p}WBSObjectId>7</{p}WBSObjectId><{p}PlannedDuration>24</{p}PlannedDuration></{p}Activity>" for i in range(30)]
    links = "".join(f"<{p}Relationship><{p}Id>R{i}</{p}Id></{p}Relationship>" for i in range(20))
    for f in "ab":
        (tmp_path / f"{f}.xml").write_text(f'<X xmlns:p="http://x"><{p}WBS><{p}ObjectId>7</{p}ObjectId><{p}Code>W{f}</{p}Code></{p}WBS>{"".join(acts)}{links}</X>')
    got = schedules.read_schedule(spark, str(tmp_path))
    assert ids(got) == sorted([(f"C{i}", "n" * (i % 70 + 1)) for i in range(30)] * 2)
    assert {r[0] for r in got.select("wbs_id").distinct().collect()} == {"Wa", "Wb"}


def test_an_open_element_at_the_end_is_none(spark, tmp_path, split):
    (tmp_path / "a.xml").write_text("<T><Id>1</Id></T>" * 20 + "<T><Id>2</Id>")
    got = elements(spark, str(tmp_path), {"T": XmlTag("T")}, {"T": lambda x: F.struct(x.alias("x"))})["T"]
    assert [r.x for r in got.select("e.*").collect()] == ["<T><Id>1</Id></T>"] * 20


def test_a_file_is_many_tasks(spark, tmp_path, split):
    (tmp_path / "a.json").write_text(json.dumps([{"id": i} for i in range(300)]))
    got = elements(spark, str(tmp_path), {"i": JsonItems()}, {"i": lambda x: F.struct(x.alias("x"))})["i"]
    assert sorted(json.loads(r.x)["id"] for r in got.select("e.*").collect()) == list(range(300))
    if split == 300:
        assert spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() > 8


def test_xer(spark, tmp_path, split):
    for f in "ab":
        task = "".join(f"%R\t{i}\t10\t{f}{i}\tDig {i}\tTK_Active\t2026-08-01 08:00\t2026-08-05 17:00\t40\r\n" for i in range(30))
        pred = "".join(f"%R\t{i}\t{i}\t{i - 1}\r\n" for i in range(1, 30))
        (tmp_path / f"{f}.xer").write_text(
            f"ERMHDR\t1.0\r\n%T\tPROJWBS\r\n%F\twbs_id\tproj_id\tparent_wbs_id\twbs_short_name\r\n%R\t10\t1\t\tW{f}\r\n%T\tOTHER\r\n%F\tx\r\n%R\t1\r\n%T\tTASK\r\n"
            f"%F\ttask_id\twbs_id\ttask_code\ttask_name\tstatus_code\ttarget_start_date\ttarget_end_date\ttarget_drtn_hr_cnt\r\n{task}%T\tTASKPRED\r\n%F\ttask_pred_id\ttask_id\tpred_task_id\r\n{pred}%E\r\n"
        )
    got = {r.activity_id: (r.activity_name, r.wbs_id, r.predecessors, r.duration_days) for r in schedules.read_schedule(spark, str(tmp_path)).collect()}
    assert got == {f"{f}{i}": (f"Dig {i}", f"W{f}", [f"{f}{i - 1}"] if i else [], 5) for f in "ab" for i in range(30)}


def test_a_written_document_is_one_file(spark):
    from plumbline.plans.source_queries import _folder

    rows = spark.range(0, 40_000, 1, 8).select((F.col("id") % 2).alias("file"), F.col("id").alias("n"))
    first = rows.groupBy("file").agg(F.min("n").alias("least"))
    lines = rows.join(first, "file").select("file", "n", F.col("least").cast("string").alias("line"))
    lines = lines.unionByName(first.select("file", F.lit(-1).cast("long").alias("n"), F.lit("head").alias("line")))
    assert len(spark.read.text(_folder(lines, "x")).inputFiles()) == 2
