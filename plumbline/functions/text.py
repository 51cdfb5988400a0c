"""Reading free-text reports: status, work type, discipline, tags, places, quantities and dates as column expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.progress import looked_up

# Phrases that tell a status; longer ones are tried first, in the order given among equal lengths.
STATUS_PHRASES = {
    "completed": "completed",
    "complete": "completed",
    "done": "completed",
    "finished": "completed",
    "fully completed": "completed",
    "fully complete": "completed",
    "installed": "completed",
    "started": "started",
    "begun": "started",
    "commenced": "started",
    "in progress": "in_progress",
    "in-progress": "in_progress",
    "ongoing": "in_progress",
    "underway": "in_progress",
    "continuing": "in_progress",
    "pending": "not_started",
    "awaiting": "not_started",
    "waiting": "not_started",
    "not started": "not_started",
    "not yet received": "not_started",
    "not received": "not_started",
    "delayed": "delayed",
    "behind schedule": "delayed",
    "blocked": "blocked",
    "held up": "blocked",
    "could not be done": "blocked",
    "cannot be done": "blocked",
    "found faulty": "blocked",
}
# Patterns that tell a status where no phrase does.
STATUS_HINTS = {
    r"\b(?:still\s+pending|not\s+yet|awaiting|material\s+not)\b": "not_started",
    r"\b(?:could\s+not|cannot|unable|faulty|failed)\b": "blocked",
}
# Words (and one phrase, which comes first of all) and the type of work that they name.
WORK_WORDS = {
    "erect": "erection",
    "erected": "erection",
    "erection": "erection",
    "erecting": "erection",
    "weld": "welding",
    "welded": "welding",
    "welding": "welding",
    "install": "installation",
    "installed": "installation",
    "installing": "installation",
    "installation": "installation",
    "test": "testing",
    "tested": "testing",
    "testing": "testing",
    "commission": "commissioning",
    "commissioned": "commissioning",
    "commissioning": "commissioning",
    "excavate": "excavation",
    "excavated": "excavation",
    "excavation": "excavation",
    "concrete": "concreting",
    "concreting": "concreting",
    "pour": "concreting",
    "poured": "concreting",
    "pouring": "concreting",
    "backfill": "backfilling",
    "backfilled": "backfilling",
    "backfilling": "backfilling",
    "insulate": "insulation",
    "insulated": "insulation",
    "insulation": "insulation",
    "hydrotest": "hydrotest",
    "hydrotesting": "hydrotest",
    "hydrotested": "hydrotest",
    "pull": "cable_pulling",
    "pulled": "cable_pulling",
    "pulling": "cable_pulling",
    "terminate": "termination",
    "terminated": "termination",
    "termination": "termination",
    "align": "alignment",
    "aligned": "alignment",
    "alignment": "alignment",
    "fabricate": "fabrication",
    "fabricated": "fabrication",
    "fabrication": "fabrication",
    "inspect": "inspection",
    "inspected": "inspection",
    "inspection": "inspection",
    "loop check": "loop_check",
    "calibrate": "calibration",
    "calibrated": "calibration",
    "calibration": "calibration",
    "paint": "painting",
    "painted": "painting",
    "painting": "painting",
    "curing": "curing",
    "glanding": "glanding",
    "set": "equipment_setting",
    "setting": "equipment_setting",
    "connect": "piping_connection",
    "connected": "piping_connection",
    "connection": "piping_connection",
}
# Keywords of the disciplines (those of over four letters count double), and equipment that decides alone.
DISCIPLINE_WORDS = {
    "piping": ["pipe", "piping", "spool", "valve", "line ", "hydrotest", "insulation", "insulate"],
    "electrical": ["cable", "electrical", "panel", "mcc", "power cable", "cable tray", "termination"],
    "civil": ["concrete", "excavation", "backfill", "foundation", "civil", "curing", "sleeper", "road", "hardstanding"],
    "instrumentation": ["instrument", "transmitter", "gauge", "control valve", "loop check", "calibration", "FT-", "PG-", "CV-"],
    "mechanical": ["pump", "compressor", "mechanical", "alignment", "equipment", "motor", "driver", "rotating", "commissioning"],
}
EQUIPMENT = {
    "mechanical": ["pump", "compressor", "motor", "driver", "turbine"],
    "instrumentation": ["transmitter", "gauge", "control valve", "calibration"],
    "electrical": ["cable", "panel", "mcc"],
    "piping": ["spool", "valve", "pipe", "piping"],
}
# Keywords in the name of a planned activity -> its type in the history, first hit wins.
PLANNED_TYPES = [
    (("hydrotest", "hydro test"), "hydrotest"),
    (("insulat",), "insulation"),
    (("valve",), "valve installation"),
    (("erect",), "erection"),
    (("weld",), "welding"),
    (("fabricat",), "erection"),
    (("cable tray",), "cable tray installation"),
    (("pull",), "cable pulling"),
    (("terminat", "gland"), "termination"),
    (("panel", "mcc"), "panel installation"),
    (("loop check",), "loop check"),
    (("transmitter", "gauge", "instrument"), "instrument installation"),
    (("excavat",), "excavation"),
    (("concret", "reinforce", "pour", "road", "hardstand"), "concreting"),
    (("backfill", "curing"), "backfilling"),
    (("align",), "alignment"),
    (("commission",), "commissioning"),
    (("set ", "setting", "connect"), "equipment setting"),
]
# Prefixes of equipment tags and the discipline that the first of them found in a text decides.
TAG_DISCIPLINES = {
    "K-": "mechanical",
    "P-": "mechanical",
    "FT-": "instrumentation",
    "PG-": "instrumentation",
    "CV-": "instrumentation",
    "CT-": "electrical",
    "PC-": "electrical",
    "IC-": "electrical",
    "M-": "electrical",
    "V-": "piping",
    "F-": "civil",
    "PS-": "civil",
}
# Tag prefixes that count only beside one of these words.
TAG_GUARDS = {"P-": ["pump"], "M-": ["mcc", "panel"]}
# Letters of equipment tags.
TAGS = ["V", "P", "K", "F", "CT", "PC", "IC", "FT", "PG", "CV", "M", "PS", "S"]
# The pattern of tags, lines, units and areas that identify work.
IDENTIFIER = r"(?i)(\b[A-Z]+-\d+\b|\bLine\s+\d+\b|\bUnit\s+\d+\b|\bArea\s+[A-Z]\b)"
# Weights of filled fields and bonuses of sources in the confidence of an extracted event.
FIELD_WEIGHTS = {"discipline": 0.15, "activity_type": 0.15, "asset": 0.20, "location": 0.10, "status": 0.15, "event_date": 0.10, "quantity": 0.05, "description": 0.10}
SOURCE_BONUS = {"discipline_report": 0.10, "excel_sheet": 0.10, "daily_report": 0.05, "supervisor_message": 0.0, "pdf_document": 0.03}


def _first(cases: list[tuple[Column, str]]) -> Column:
    out = F.lit(None).cast("string")
    for test, value in reversed(cases):
        out = F.when(test, value).otherwise(out)
    return out


def reported_status(text: Column) -> Column:
    """The status that a text tells, longest phrase first, then by the hints in it; "unknown" if none."""
    low = F.lower(F.trim(text))
    phrases = sorted(STATUS_PHRASES.items(), key=lambda x: -len(x[0]))
    hints = _first([(low.rlike(p), s) for p, s in STATUS_HINTS.items()])
    return F.coalesce(_first([(low.contains(p), s) for p, s in phrases]), hints, F.lit("unknown"))


def work_type(text: Column) -> Column:
    """The type of work that the first known word tells; a loop check is told by its phrase."""
    low = F.lower(text)
    words = F.regexp_extract_all(low, F.lit(r"(\w+)"), F.lit(1))
    found = F.filter(F.transform(words, lambda w: looked_up(w, WORK_WORDS)), lambda k: k.isNotNull())
    return F.when(low.contains("loop check"), "loop_check").otherwise(F.get(found, F.lit(0)))


def planned_type(name: Column) -> Column:
    low = F.lower(F.coalesce(name, F.lit("")))
    cases = [(low.rlike("|".join(words)), kind) for words, kind in PLANNED_TYPES]
    return F.coalesce(_first(cases), F.lit(""))


def discipline(text: Column) -> Column:
    """The first tag prefix that decides, else equipment that decides alone, else the discipline whose keywords weigh most
    (the first of equals), else null."""
    low = F.lower(text)
    guard = lambda tag: reduce(or_, [low.contains(w) for w in TAG_GUARDS.get(tag, [""])])
    tagged = _first([(low.contains(tag.lower()) & guard(tag), d) for tag, d in TAG_DISCIPLINES.items()])
    sure = _first([(low.rlike("|".join(words)), d) for d, words in EQUIPMENT.items()])
    scores = [
        sum((F.when(low.contains(w.lower()), 2 if len(w) > 4 else 1).otherwise(0) for w in words), F.lit(0))
        for words in DISCIPLINE_WORDS.values()
    ]
    top = F.greatest(*scores)
    ranked = _first([((s == top) & (top > 0), d) for d, s in zip(DISCIPLINE_WORDS, scores, strict=True)])
    return F.coalesce(tagged, sure, ranked)


def assets(text: Column) -> Column:
    """Distinct equipment names in a text: lines first, then tags kind by kind."""
    every = lambda p: F.regexp_extract_all(text, F.lit(p), F.lit(1))
    line = lambda found: F.transform(found, lambda x: F.concat(F.lit("Line "), x))
    kinds = [
        line(every(r"(?i)\bline\s+(\d+(?:-[A-Z0-9]+)?)\b")),
        line(every(r"(?i)\bL-?(\d+(?:-[A-Z0-9]+)?)\b")),
        line(F.transform(every(r"(?i)\b(\d+)-XX\b"), lambda x: F.concat(x, F.lit("-XX")))),
    ]
    for tag in TAGS:
        what = r"[A-Z0-9]+" if tag == "CT" else r"\d+[A-Z]?"
        kinds.append(F.transform(every(rf"(?i)\b({tag}-{what})\b"), F.upper))
    return F.array_distinct(F.concat(*kinds))


def location(text: Column) -> Column:
    """The first place named, by kind of place."""
    part = lambda p: F.nullif(F.regexp_extract(text, p, 1), F.lit(""))
    return F.coalesce(
        F.concat(F.lit("Unit "), part(r"\b[Uu]nit\s+(\d+)\b")),
        F.concat(F.lit("Area "), part(r"\b[Aa]rea\s+([A-Z0-9]+)\b")),
        F.when(text.rlike(r"\b[Ss]ubstation\b"), "Substation"),
        F.when(text.rlike(r"\b[Ff]abrication\s+[Yy]ard\b"), "Fabrication Yard"),
        F.concat(F.lit("Pipe Rack "), part(r"\b[Pp]ipe\s+[Rr]ack\s+([A-Z])\b")),
        F.when(text.rlike(r"\b[Pp]ipe\s+[Rr]ack\b"), "Pipe Rack"),
    )


def quantity(text: Column) -> Column:
    """struct(quantity double, unit string): "n of m" first, then metres, spools, joints, percent; not the number of a line."""
    kinds = [
        (r"\d+\s+of\s+\d+", r"(\d+)\s+of", F.concat(F.lit("of "), F.regexp_extract(text, r"(?i)\d+\s+of\s+(\d+)", 1).cast("decimal(38,0)").cast("string"))),
        (r"\d+(?:\.\d+)?\s*(?:metres|meters|m)\b", r"(\d+(?:\.\d+)?)\s*(?:metres|meters|m)\b", F.lit("metres")),
        (r"\d+(?:\.\d+)?\s*spools?\b", r"(\d+(?:\.\d+)?)\s*spools?\b", F.lit("spools")),
        (r"\d+(?:\.\d+)?\s*joints?\b", r"(\d+(?:\.\d+)?)\s*joints?\b", F.lit("joints")),
        (r"\d+(?:\.\d+)?\s*(?:percent|%)", r"(\d+(?:\.\d+)?)\s*(?:percent|%)", F.lit("%")),
    ]
    out = F.lit(None)
    for whole, number, unit in reversed(kinds):
        before = F.regexp_extract(text, rf"(?is)^(.*?)(?:{whole})", 1)
        ok = text.rlike(f"(?i){whole}") & ~before.rlike(r"(?i)(?:line|l-?)\s*$")
        got = F.struct(F.regexp_extract(text, f"(?i){number}", 1).cast("double").alias("quantity"), unit.alias("unit"))
        out = F.when(ok, got).otherwise(out)
    return out


def event_date(text: Column, reference: Column | None = None) -> Column:
    """The date that a text names: words relative to the reference date, then ISO, d-m-y, and named months."""
    low = F.lower(text)
    take = lambda p, *fmts: F.coalesce(*[F.try_to_date(F.nullif(F.regexp_extract(text, p, 1), F.lit("")), f) for f in fmts])
    ways = []
    if reference is not None:
        ways = [F.when(low.contains("today"), reference), F.when(low.contains("yesterday"), F.date_sub(reference, 1)), F.when(low.contains("tomorrow"), F.date_add(reference, 1))]
    ways += [
        take(r"\b(\d{4}-\d{1,2}-\d{1,2})\b", "yyyy-M-d"),
        take(r"\b(\d{1,2}[-/]\d{1,2}[-/]\d{4})\b", "d-M-yyyy", "d/M/yyyy"),
        take(r"\b(\d{1,2} [A-Z][a-z]+ \d{4})\b", "d MMMM yyyy", "d MMM yyyy"),
        take(r"\b([A-Z][a-z]+ \d{1,2},? \d{4})\b", "MMMM d, yyyy", "MMM d, yyyy", "MMMM d yyyy", "MMM d yyyy"),
    ]
    return F.coalesce(*ways)


def schedule_date(raw: Column) -> Column:
    """The date of a schedule export, without its time of day; day before month where both are possible."""
    head = F.regexp_extract(F.trim(raw), r"^([^ T]+)", 1)
    fmts = ["yyyy-MM-dd", "dd-MM-yyyy", "dd/MM/yyyy", "MM/dd/yyyy", "dd-MMM-yy", "dd-MMM-yyyy", "yyyy/MM/dd", "dd.MM.yyyy"]
    rescue = F.regexp_extract(raw, r"(\d{4}-\d{1,2}-\d{1,2})", 1)
    return F.coalesce(*[F.try_to_date(head, f) for f in fmts], F.try_to_date(F.nullif(rescue, F.lit("")), "yyyy-M-d"))


def identifiers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(IDENTIFIER), F.lit(1))


def is_vague(text: Column) -> Column:
    return F.size(F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")) <= 6


def extraction_confidence(fields: dict[str, Column], source: Column) -> Column:
    """The weight of the filled fields and the source's bonus, 0.99 at most. fields has raw_text too."""
    raw, said = fields["raw_text"], F.coalesce(fields["description"], F.lit(""))
    there = {k: fields[k].isNotNull() for k in FIELD_WEIGHTS if k != "description"}
    there["status"] = there["status"] & (fields["status"] != "unknown")
    there["description"] = (F.length(said) > 10) & ~said.eqNullSafe(raw)
    total = sum((F.when(there[k], w).otherwise(0.0) for k, w in FIELD_WEIGHTS.items()), F.lit(0.0))
    total = total + F.coalesce(looked_up(source, SOURCE_BONUS), F.lit(0.0))
    return F.round(F.least(total, F.lit(0.99)).cast("decimal(38,10)"), 2).cast("double")


def missing_fields(fields: dict[str, Column]) -> Column:
    order = ["asset", "discipline", "status", "location", "activity_type"]
    lacks = lambda k: fields[k].isNull() | ((fields[k] == "unknown") if k == "status" else F.lit(False))
    return F.array_compact(F.array(*[F.when(lacks(k), F.lit(k)) for k in order]))


def needs_clarification(confidence: Column, missing: Column) -> Column:
    return (confidence < 0.80) & F.arrays_overlap(missing, F.array(F.lit("asset"), F.lit("discipline"), F.lit("status")))


def search_text(*parts: Column) -> Column:
    return F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts])
