"""Readers of field reports and history: daily report text, discipline sheets, messages, history CSV; their sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.functions.progress import looked_up
from plumbline.operators.scan import row_number, scanned

# Beginnings of lines that tell no work.
META = r"(?i)^\s*(project|date|prepared by|report|weather|page)\b"


def daily_report(content: DataFrame) -> DataFrame:
    """(report_date, section, discipline, pos, sentence) of report texts (column value): sections === NAME ===, sentences.

    Lines that tell no work and sentences of five characters or less go; issues and delays have no discipline."""
    day = T.event_date(F.regexp_extract("value", r"(?im)^\s*date\s*:\s*(.+)$", 1))
    parts = F.split("value", r"(?m)^\s*===\s*(?=\S)")
    sections = content.withColumn("report_date", day).select("report_date", F.posexplode(parts).alias("s", "body")).where("s > 0")
    named = sections.select("report_date", "s", F.trim(F.regexp_extract("body", r"^(.*?)\s*===", 1)).alias("section"), F.regexp_replace("body", r"^.*?===", "").alias("body"))
    lines = named.select("report_date", "s", "section", F.posexplode(F.split("body", "\r?\n")).alias("l", "line")).where(~F.col("line").rlike(META))
    said = lines.select("report_date", "s", "section", "l", F.posexplode(F.split("line", r"[.!]\s+")).alias("k", "sentence"))
    said = said.withColumn("sentence", F.trim(F.regexp_replace("sentence", r"[.!]\s*$", ""))).where(F.length("sentence") > 5)
    low = F.lower("section")
    found = F.when(low.rlike("issue|delay"), None).otherwise(F.regexp_extract(low, r"(piping|electrical|civil|instrumentation|mechanical)", 1))
    order = F.struct("s", "l", "k")
    return said.select("report_date", "section", F.nullif(found, F.lit("")).alias("discipline"), order.alias("pos"), "sentence")


def extracted(said: DataFrame, text: str = "sentence", source: str = "daily_report") -> DataFrame:
    """Events read from sentences: status, work type, discipline, tags, place, quantity, date, confidence, what is missing."""
    t = F.col(text)
    have = said.columns
    q = T.quantity(t)
    fields = {
        "raw_text": t,
        "status": T.reported_status(t),
        "activity_type": T.work_type(t),
        "discipline": F.coalesce(F.col("discipline"), T.discipline(t)) if "discipline" in have else T.discipline(t),
        "asset": F.get(T.assets(t), F.lit(0)),
        "location": T.location(t),
        "quantity": q["quantity"],
        "event_date": F.coalesce(F.col("report_date"), T.event_date(t)) if "report_date" in have else T.event_date(t),
    }
    out = said.withColumns({**fields, "unit": q["unit"]})
    made = F.concat_ws(" ", F.initcap(F.translate("activity_type", "_", " ")), "asset", F.when(F.col("location").isNotNull(), F.concat(F.lit("at "), F.col("location"))))
    out = out.withColumn("description", F.coalesce(F.nullif(made, F.lit("")), F.col("raw_text")))
    cols = {k: F.col(k) for k in [*fields, "description"]}
    out = out.withColumn("confidence", T.extraction_confidence(cols, F.lit(source))).withColumn("missing", T.missing_fields(cols))
    return out.withColumn("needs_clarification", T.needs_clarification(F.col("confidence"), F.col("missing")))


def sheet(spark: SparkSession, path: str) -> DataFrame:
    """Rows of disciplines' field sheets (CSV files of one shape): raw text, status as it stands and normalised, quantity,
    unit, date, source_file, and source_reference, row_n for the n-th line of its file, the header being the first.

    Rows without a description go, but are counted. Places come from a scan over the order of files, so that neither one
    large file nor many small ones are one task."""
    df = spark.read.csv(path, header=True)
    have = {c.strip().lower().replace(" ", "_"): c for c in df.columns}
    pick = lambda *names: next((F.nullif(F.trim(F.col(f"`{have[n]}`")), F.lit("")) for n in names if n in have), F.lit(None).cast("string"))
    what, place, status = pick("activity_description", "description", "activity"), pick("location", "area"), pick("status")
    rows = df.select(
        what.alias("description"), F.concat_ws(",", what, place, status).alias("sentence"), F.lower(pick("discipline")).alias("discipline"), place.alias("location"), F.coalesce(F.lower(status), F.lit("unknown")).alias("status_raw"),
        F.coalesce(F.regexp_replace(F.lower(status), r"[\s-]+", "_"), F.lit("unknown")).alias("status"), pick("quantity").try_cast("double").alias("quantity"), pick("unit").alias("unit"), T.schedule_date(pick("date")).alias("report_date"),
        F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("pos"),
    )
    order = ["source_file", "block", "pos"]
    rows = scanned(rows, order, n=row_number())
    first = rows.groupBy("source_file").agg(F.min("n").alias("first"))  # one row a file
    rows = rows.join(first, "source_file").where("description is not null")
    return rows.withColumn("source_reference", F.concat(F.lit("row_"), (F.col("n") - F.col("first") + 2).cast("string"))).drop("description", "block", "pos", "n", "first")


# The fields of labelled truth.
TRUTH = "event_id string, input_text string, source string, difficulty string, correct_activity_id string, correct_activity_name string, note string"


def labelled_truth(spark: SparkSession, path: str) -> DataFrame:
    """Labelled reports: files of JSON arrays, each file one task; entries without a text go."""
    return spark.read.schema(TRUTH).json(path, multiLine=True).select(*[f.split()[0] for f in TRUTH.split(", ")]).where("input_text is not null")


def history_csv(spark: SparkSession, path: str) -> DataFrame:
    """History records with lenient casts: bad whole numbers are 0, bad decimals null, true, 1 and yes are true; ids are hashes."""
    df = spark.read.csv(path, header=True)
    col = lambda n: F.col(n) if n in df.columns else F.lit(None).cast("string")
    whole = lambda n: F.coalesce(col(n).try_cast("double").cast("int"), F.lit(0))
    return df.select(
        F.sha2(F.concat_ws("|", *df.columns), 256).alias("record_id"), col("project_id").alias("project_id"), col("discipline").alias("discipline"), col("activity_type").alias("activity_type"),
        col("location_type").alias("location_type"), whole("planned_duration_days").alias("planned_days"), whole("actual_duration_days").alias("actual_days"), whole("variance_days").alias("variance_days"),
        F.coalesce(F.lower(F.trim(col("delayed"))).isin("true", "1", "yes"), F.lit(False)).alias("delayed"), F.nullif(col("delay_cause"), F.lit("")).alias("delay_cause"),
        col("productivity_rate").try_cast("double").alias("productivity"), F.coalesce(F.nullif(col("record_quality"), F.lit("")), F.lit("provisional")).alias("record_quality"),
    )


def save_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).csv(path, header=True)


def append_log(df: DataFrame, path: str) -> None:
    """Audit entries and feedback: rows are added, never changed."""
    df.write.mode("append").parquet(path)


def question_intent(question: Column) -> Column:
    """Which canned query a question asks for; the first rule that fits wins."""
    rules = [
        (r"(?i)\b(how long|duration|typical(ly)? takes?)\b", "duration_by_type"),
        (r"(?i)\b(cause|causes|why|reason|reasons)\b", "top_delay_causes"),
        (r"(?i)\b(over|exceed\w*|beyond)\b.*\b(baseline|plan|planned)\b", "over_baseline"),
        (r"(?i)\b(productivity|rate|benchmark)\b", "productivity_benchmark"),
        (r"(?i)\b(risk|risky|profile)\b", "risk_profile"),
        (r"(?i)\bdelays?\b", "delay_by_category"),
    ]
    out = F.lit("search")
    for pattern, name in reversed(rules):
        out = F.when(question.rlike(pattern), name).otherwise(out)
    return out


__all__ = ["append_log", "daily_report", "extracted", "history_csv", "looked_up", "question_intent", "save_csv", "sheet"]
