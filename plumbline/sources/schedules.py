"""Readers of planned schedules: CSV/TSV, JSON, P6 XER, P6 XML, MS Project XML -> one schema.

All readers give activity_id, activity_name, wbs_id, wbs_level int, discipline, location, start_raw, finish_raw,
planned_start, planned_finish date, duration_days int, predecessors, successors array<string>, status, source_file. Inputs
are any path that Spark reads, a file or a folder of files of one format; only the head of one is looked at on the driver,
to tell the format. Numbers that files use inside, of tasks and nodes, belong to their file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.progress import export_status
from plumbline.functions.text import schedule_date
from plumbline.operators.quality import level_of
from plumbline.operators.scan import running_last, scanned, scratch
from plumbline.sources.splits import JsonItems, XmlTag, elements, xer_tables

# Column names that stand for a field, the first that is there counts.
ALIASES = {
    "activity_id": ["activity_id", "activity id", "task_id", "task id", "task_code", "act_id", "id"],
    "activity_name": ["activity_name", "activity name", "task_name", "task name", "name", "description", "activity description"],
    "wbs_id": ["wbs_id", "wbs id", "wbs", "wbs_code", "wbs code", "outline_number", "outline number"],
    "wbs_level": ["wbs_level", "wbs level", "level", "outline_level", "outline level"],
    "discipline": ["discipline", "disc", "trade", "department"],
    "location": ["location", "area", "unit", "work area", "plant area", "zone"],
    "start_raw": ["planned_start", "planned start", "start", "start date", "target_start_date", "target start"],
    "finish_raw": ["planned_finish", "planned finish", "finish", "finish date", "target_end_date", "target finish"],
    "duration_raw": ["duration_days", "duration", "planned duration", "original duration", "target_drtn_hr_cnt"],
    "predecessors": ["predecessors", "predecessor", "pred", "preds", "predecessor_ids"],
    "successors": ["successors", "successor", "succ", "succs", "successor_ids"],
    "status": ["status", "activity status", "activity_status", "status_code"],
}
HOURS = 8  # of a working day
# Tables of XER files that are read, with their fields.
XER_TABLES = {
    "TASK": ["task_id", "task_code", "task_name", "wbs_id", "target_drtn_hr_cnt", "target_start_date", "target_end_date", "early_start_date", "early_end_date", "status_code"],
    "PROJWBS": ["wbs_id", "wbs_short_name"],
    "TASKPRED": ["task_id", "pred_task_id"],
}


def detect(path: str, head: str) -> str:
    """Format of a schedule from its name and its first characters: xer, msproject_xml, primavera_xml, json, csv, unknown."""
    low, name = head.lstrip().lower(), path.lower()
    if name.endswith(".xer") or low.startswith("ermhdr"):
        return "xer"
    if name.endswith((".xml", ".mspdi")) or low.startswith("<"):
        return "msproject_xml" if "schemas.microsoft.com/project" in low or "<tasks>" in low else "primavera_xml"
    if name.endswith(".json") or low[:1] in ("{", "["):
        return "json"
    if name.endswith((".csv", ".tsv", ".txt")) or any(c in low.split("\n")[0] for c in ",;\t"):
        return "csv"
    return "unknown"


def read_schedule(spark: SparkSession, path: str, text: str | None = None) -> DataFrame:
    """The activities of a file or a folder of files, or of text given as content; an unknown format is read as CSV."""
    if text is not None:
        whole = spark.createDataFrame([("", text)], "file string, value string")
        kind = detect(path, text[:4096])
        return {"xer": from_xer, "primavera_xml": from_p6_xml, "msproject_xml": from_msproject_xml, "json": from_json}.get(kind, lambda w: from_csv_lines(w, text[:4096]))(whole)
    one = sorted(spark.read.text(path).inputFiles())[0]
    head = first_bytes(spark, one)
    kind = detect(one, head)
    if kind == "xer":
        held = scratch(xer_tables(spark, path, XER_TABLES), "xer-records")
        return xer_activities(*[held.where(F.col("table") == t).select("file", F.struct(*[F.get("record", F.lit(i)).alias(f) for i, f in enumerate(fields)]).alias("record")) for t, fields in XER_TABLES.items()])
    if kind == "primavera_xml":
        tags = {"Activity": _P6, "WBS": _P6_WBS}
    elif kind == "msproject_xml":
        tags = {"Task": _MSP}
    elif kind == "json":
        item = lambda x: F.get(F.transform(F.array(F.try_parse_json(x)), _json_fields), F.lit(0))  # noqa: E731  # parsed once
        return _typed(elements(spark, path, {"item": JsonItems()}, {"item": item})["item"].select("file", "e.*"))
    if kind in ("primavera_xml", "msproject_xml"):
        got = elements(spark, path, {t: XmlTag(t) for t in tags}, {t: (lambda x, schema=schema: F.from_xml(_bare(x), schema)) for t, schema in tags.items()})
        got = [got[t].select("file", "e.*") for t in tags]
        return p6_activities(*got) if kind == "primavera_xml" else msproject_activities(*got)
    sep = _separator(head.split("\n")[0])
    rows = spark.read.csv(path, header=True, sep=sep, mode="PERMISSIVE")
    return from_columns(rows.select("*", F.col("_metadata.file_path").alias("__file")))


def first_bytes(spark: SparkSession, file: str, n: int = 4096) -> str:
    """The first characters of a file, without reading more of it."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(file)
    stream = at.getFileSystem(sc._jsc.hadoopConfiguration()).open(at)
    try:
        return bytes(stream.readNBytes(n)).decode("utf-8", "ignore")
    finally:
        stream.close()


def contents(spark: SparkSession, path: str) -> DataFrame:
    """(file, value): the files of a path, each as one text."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")


def _filed(content: DataFrame) -> DataFrame:
    return content if "file" in content.columns else content.withColumn("file", F.lit(""))


def _separator(line: str) -> str:
    return "\t" if "\t" in line and "," not in line else ";" if ";" in line and "," not in line else ","


def from_csv_lines(content: DataFrame, head: str) -> DataFrame:
    """CSV held as one text: lines are parsed by from_csv against the header's columns."""
    first = head.split("\n")[0].strip()
    sep = _separator(first)
    names = [n.strip().strip('"') for n in first.split(sep)]
    schema = ", ".join(f"`{n}` string" for n in names)
    lines = content.select(F.posexplode(F.split("value", "\r?\n")).alias("pos", "line")).where("pos > 0 and trim(line) <> ''")
    return from_columns(lines.select(F.from_csv("line", schema, {"sep": sep}).alias("r")).select("r.*"))


def from_columns(df: DataFrame) -> DataFrame:
    """Any table whose columns are known by ALIASES, regardless of case and blanks."""
    have = {c.strip().lower().replace(" ", "_"): c for c in df.columns}
    pick = {}
    for field, names in ALIASES.items():
        at = next((have[n.replace(" ", "_")] for n in names if n.replace(" ", "_") in have), None)
        pick[field] = F.col(f"`{at}`") if at else F.lit(None).cast("string")
    file = F.col("__file") if "__file" in df.columns else F.lit("")
    return _typed(df.select(*[v.alias(k) for k, v in pick.items()], file.alias("file")))


def _edges(c: str, kind: str) -> Column:
    if kind.startswith("array"):
        return F.col(c)
    parts = F.transform(F.split(F.regexp_replace(F.coalesce(c, F.lit("")), ";", ","), ","), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


def _typed(df: DataFrame) -> DataFrame:
    kind = dict(df.dtypes)
    df = df.withColumns({"planned_start": schedule_date(F.col("start_raw").cast("string")), "planned_finish": schedule_date(F.col("finish_raw").cast("string"))})
    number = F.regexp_replace(F.lower(F.col("duration_raw").cast("string")), r"[hd]|days?|hours?", "").try_cast("double")
    given = F.when(number.isNotNull(), F.greatest(F.lit(0), F.round(number))).cast("int")
    return df.select(
        "activity_id", "activity_name", "wbs_id", level_of(F.col("wbs_level").cast("string")).alias("wbs_level"), "discipline", "location", "start_raw", "finish_raw",
        "planned_start", "planned_finish", F.coalesce(given, F.datediff("planned_finish", "planned_start") + 1, F.lit(1)).alias("duration_days"),
        _edges("predecessors", kind["predecessors"]).alias("predecessors"), _edges("successors", kind["successors"]).alias("successors"), export_status(F.col("status").cast("string")).alias("status"), F.col("file").alias("source_file"),
    )


def from_json(content: DataFrame) -> DataFrame:
    """A list of activities, or an object that holds one under `activities`; edges as lists or comma text."""
    doc = F.try_parse_json("value")
    items = F.coalesce(F.try_variant_get(doc, "$.activities", "array<variant>"), F.try_variant_get(doc, "$", "array<variant>"))
    rows = _filed(content).select("file", F.explode(items).alias("a"))
    return _typed(rows.select("file", _json_fields(F.col("a")).alias("e")).select("file", "e.*"))


def _json_fields(a: Column) -> Column:
    """The fields of ALIASES of an activity, as one struct of texts."""
    get = lambda field: F.coalesce(*[F.try_variant_get(a, f"$.{n}", "string") for n in ALIASES[field]])
    lists = lambda field: F.coalesce(*[F.array_join(F.try_variant_get(a, f"$.{n}", "array<string>"), ",") for n in ALIASES[field]], get(field))
    return F.struct(*[(lists(f) if f in ("predecessors", "successors") else get(f)).alias(f) for f in ALIASES])


def xer_records(lines: DataFrame) -> DataFrame:
    """(file, block, pos, table, record map) of P6 XER lines(file, block, pos, line): %T names a table, %F its fields, %R a record.

    Which table and fields a record has is filled forward over all lines by a scan, so that a large text is many tasks."""
    cells = lines.withColumn("cells", F.split("line", "\t")).withColumn("tag", F.get("cells", F.lit(0)))
    rest = F.slice("cells", 2, F.greatest(F.size("cells") - 1, F.lit(0)))
    cells = cells.withColumn("rest", rest).where(F.col("tag").isin("%T", "%F", "%R"))
    filled = scanned(cells, ["file", "block", "pos"], table=running_last(F.when(F.col("tag") == "%T", F.get("cells", F.lit(1)))), fields=running_last(F.when(F.col("tag") == "%F", F.col("rest"))))
    values = F.transform("fields", lambda f, i: F.nullif(F.get("rest", i), F.lit("")))
    return filled.where("tag = '%R'").select("file", "block", "pos", "table", F.map_from_arrays("fields", values).alias("record"))


def from_xer(content: DataFrame) -> DataFrame:
    """The activities of XER texts (column value, and file if there are several)."""
    lines = _filed(content).select("file", F.lit(0).cast("long").alias("block"), F.posexplode(F.split("value", "\r?\n")).alias("pos", "line"))
    recs = xer_records(lines)
    return xer_activities(*[recs.where(F.col("table") == t).select("file", "record") for t in XER_TABLES])


def xer_activities(task: DataFrame, wbs: DataFrame, link: DataFrame) -> DataFrame:
    """Activities of the records (file, record by field) of the tables of XER_TABLES, in their order."""
    g = lambda k: F.col("record")[k]
    task = task.select("file", g("task_id").alias("task_id"), "record")
    wbs = wbs.select("file", g("wbs_id").alias("wbs_key"), g("wbs_short_name").alias("wbs_code"))
    link = link.select("file", g("task_id").alias("task_id"), g("pred_task_id").alias("pred"))
    code = task.select("file", F.col("task_id").alias("key"), F.col("record")["task_code"].alias("code"))
    named = (
        link.join(code.select("file", F.col("key").alias("task_id"), F.col("code").alias("c")), ["file", "task_id"], "left")
        .join(code.select("file", F.col("key").alias("pred"), F.col("code").alias("p")), ["file", "pred"], "left")
        .select("file", "task_id", "pred", F.coalesce("c", "task_id").alias("c"), F.coalesce("p", "pred").alias("p"))
    )
    preds = named.groupBy("file", "task_id").agg(F.sort_array(F.collect_set("p")).alias("predecessors"))
    succs = named.groupBy("file", F.col("pred").alias("task_id")).agg(F.sort_array(F.collect_set("c")).alias("successors"))
    t = task.join(preds, ["file", "task_id"], "left").join(succs, ["file", "task_id"], "left")
    t = t.withColumn("wbs_key", g("wbs_id")).join(wbs, ["file", "wbs_key"], "left")
    none = F.lit(None).cast("string")
    empty = F.array().cast("array<string>")
    hours = g("target_drtn_hr_cnt").try_cast("double")
    days = F.greatest(F.lit(1), F.bround(hours / HOURS)).cast("int").cast("string")
    return _typed(
        t.select(
            "file", F.coalesce(g("task_code"), F.col("task_id")).alias("activity_id"), g("task_name").alias("activity_name"), F.coalesce("wbs_code", "wbs_key").alias("wbs_id"), none.alias("wbs_level"),
            none.alias("discipline"), none.alias("location"), F.coalesce(g("target_start_date"), g("early_start_date")).alias("start_raw"), F.coalesce(g("target_end_date"), g("early_end_date")).alias("finish_raw"),
            days.alias("duration_raw"), F.coalesce("predecessors", empty).alias("predecessors"), F.coalesce("successors", empty).alias("successors"), g("status_code").alias("status"),
        )
    )


_P6 = ", ".join(f"{f} string" for f in ["Id", "Name", "WBSObjectId", "WBSCode", "PlannedStartDate", "PlannedFinishDate", "PlannedDuration", "Status"])
_P6_WBS = "ObjectId string, Code string"
_MSP = "UID string, Name string, WBS string, OutlineLevel string, OutlineNumber string, Summary string, Start string, Finish string, Duration string, PredecessorLink array<struct<PredecessorUID:string>>"


def _bare(xml: Column) -> Column:
    """XML without namespaces."""
    return F.regexp_replace(F.regexp_replace(xml, r"\sxmlns(:\w+)?=\"[^\"]*\"", ""), r"<(/?)\w+:", "<$1")


def _elements(content: DataFrame, tag: str, schema: str) -> DataFrame:
    """The elements `tag` of XML text, namespaces left out, by Spark's own XML parser."""
    parts = F.regexp_extract_all(_bare(F.col("value")), F.lit(rf"(?s)(<{tag}(?:\s[^>]*)?>.*?</{tag}>)"), F.lit(1))
    return _filed(content).select("file", F.explode(parts).alias("x")).select("file", F.from_xml("x", schema).alias("e")).select("file", "e.*")


def from_p6_xml(content: DataFrame) -> DataFrame:
    """Activities of P6 XML texts."""
    return p6_activities(_elements(content, "Activity", _P6), _elements(content, "WBS", _P6_WBS))


def p6_activities(a: DataFrame, wbs: DataFrame) -> DataFrame:
    """Activities of a P6 XML export; planned durations are hours, and edges are not part of it."""
    wbs = wbs.select("file", F.col("ObjectId").alias("WBSObjectId"), F.col("Code").alias("code"))
    a = a.join(wbs, ["file", "WBSObjectId"], "left")
    none, empty = F.lit(None).cast("string"), F.array().cast("array<string>")
    days = F.greatest(F.lit(1), F.bround(F.col("PlannedDuration").try_cast("double") / HOURS)).cast("int").cast("string")
    return _typed(
        a.select(
            "file", F.col("Id").alias("activity_id"), F.col("Name").alias("activity_name"), F.coalesce("code", "WBSCode", "WBSObjectId").alias("wbs_id"), none.alias("wbs_level"), none.alias("discipline"), none.alias("location"),
            F.col("PlannedStartDate").alias("start_raw"), F.col("PlannedFinishDate").alias("finish_raw"), days.alias("duration_raw"), empty.alias("predecessors"), empty.alias("successors"), F.col("Status").alias("status"),
        )
    )


def iso_days(raw: Column) -> Column:
    """Days of an ISO 8601 duration: PT40H... in working days, P5D as it is, 1 at least."""
    hours = F.regexp_extract(raw, r"PT(\d+)H", 1).try_cast("double")
    days = F.regexp_extract(raw, r"P(\d+)D", 1).try_cast("double")
    return F.greatest(F.lit(1), F.bround(F.coalesce(hours / HOURS, days, F.lit(1.0)))).cast("int")


def from_msproject_xml(content: DataFrame) -> DataFrame:
    """Tasks of MS Project XML texts."""
    return msproject_activities(_elements(content, "Task", _MSP))


def msproject_activities(t: DataFrame) -> DataFrame:
    """Tasks of MS Project XML that are no summaries; ids from the name before a colon, else WBS, else the UID."""
    part = F.nullif(F.regexp_extract("Name", r"^([A-Za-z0-9._-]+)\s*:", 1), F.lit(""))
    t = t.withColumn("activity_id", F.coalesce(part, F.nullif("WBS", F.lit("")), F.concat(F.lit("TASK-"), F.col("UID"))))
    ids = t.select("file", F.col("UID").alias("p_uid"), F.col("activity_id").alias("p_id"))
    links = t.select("file", "UID", F.posexplode("PredecessorLink.PredecessorUID").alias("pos", "p_uid")).join(ids, ["file", "p_uid"], "left")
    preds = links.groupBy("file", "UID").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("p_id", "p_uid").alias("p")))).alias("ps")).select("file", "UID", F.col("ps.p").alias("predecessors"))
    t = t.where(F.coalesce(F.col("Summary"), F.lit("0")) != "1").join(preds, ["file", "UID"], "left")
    none, empty = F.lit(None).cast("string"), F.array().cast("array<string>")
    name = F.trim(F.regexp_replace("Name", r"^[A-Za-z0-9._-]+\s*:", ""))
    return _typed(
        t.select(
            "file", "activity_id", name.alias("activity_name"), F.coalesce("WBS", "OutlineNumber").alias("wbs_id"), F.col("OutlineLevel").alias("wbs_level"), none.alias("discipline"), none.alias("location"),
            F.col("Start").alias("start_raw"), F.col("Finish").alias("finish_raw"), iso_days(F.col("Duration")).cast("string").alias("duration_raw"), F.coalesce("predecessors", empty).alias("predecessors"), empty.alias("successors"), none.alias("status"),
        )
    )
