"""Labels as they are written and as they are compared: aliases, normal forms, what a question asks, what has to be asked."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.text import _first

# Names that schedules use for a discipline; the first discipline of which a name is a word of the label decides.
DISCIPLINE_ALIASES = {
    "piping": ["piping", "pip", "pipe", "pipework", "pipeline", "piping works"],
    "electrical": ["electrical", "elec", "ele", "elect", "e&i", "power", "cable", "substation"],
    "civil": ["civil", "civ", "earthworks", "concrete", "structural", "excavation", "foundation"],
    "mechanical": ["mechanical", "mech", "mec", "static equipment", "rotating equipment", "equipment"],
    "instrumentation": ["instrumentation", "inst", "ins", "telecom", "automation", "scada", "control"],
    "hse": ["hse", "safety", "environmental", "fire"],
}
# Disciplines and activity types that questions can name.
ASKED_DISCIPLINES = ["piping", "electrical", "civil", "instrumentation", "mechanical"]
ASKED_TYPES = [
    "erection", "welding", "hydrotest", "insulation",
    "cable tray installation", "cable pulling", "termination", "panel installation",
    "excavation", "concreting", "backfilling",
    "instrument installation", "loop check",
    "equipment setting", "alignment", "commissioning",
    "valve installation",
]
# What a confirmed field adds to the confidence of a report, and the most that it can be.
CONFIRMED, MOST = 0.15, 0.99


def discipline_alias(raw: Column) -> Column:
    """The discipline that a label means; a label of none is kept in lower case, an empty one is null."""
    low = F.lower(F.trim(raw))
    named = [(low.rlike(r"\b(?:" + "|".join(map(re.escape, names)) + r")\b"), d) for d, names in DISCIPLINE_ALIASES.items()]
    return F.when(raw != "", F.coalesce(_first(named), low))


def plain(text: Column, drop: str = r"[^\w\s\-.]", put: str = " ") -> Column:
    """Lower case with single blanks; signs become `put`. Matching drops r"[^\\w\\s-]" and puts nothing. Null is empty."""
    clean = F.regexp_replace(F.coalesce(text, F.lit("")), "(?U)" + drop, put)
    return F.lower(F.trim(F.regexp_replace(clean, r"\s+", " ")))


def asset_name(raw: Column) -> Column:
    """L24 and L-24 are Line 24; other names stay."""
    return F.regexp_replace(F.trim(raw), r"(?i)^L-?(\d.*)$", "Line $1")


def comparable(label: Column) -> Column:
    """The form in which extracted and expected labels are compared."""
    return F.translate(F.lower(F.trim(label)), "-_", "  ")


def same_label(said: Column, expected: Column) -> Column:
    """Whether a label is as expected; where nothing is expected, all is right."""
    return expected.isNull() | F.coalesce(comparable(said) == comparable(expected), F.lit(False))


def asked_discipline(question: Column) -> Column:
    low = F.lower(question)
    return _first([(low.contains(d), d) for d in ASKED_DISCIPLINES])


def asked_type(question: Column) -> Column:
    """The longest activity type in a question."""
    low = F.lower(question)
    return _first([(low.contains(t), t) for t in sorted(ASKED_TYPES, key=lambda t: -len(t))])


def clarification_question(text: Column, names: Column) -> Column:
    """What to ask where candidates (array of names, best first) lie close: equipment, then place, then anything more."""
    tagged = text.rlike(r"(?i)\b[A-Z]+-\d+\b") | text.rlike(r"(?i)\bline\b")
    ask = F.when(~tagged, F.concat(F.lit("Which line or equipment does '"), text, F.lit("' refer to?")))
    ask = ask.when(~text.rlike(r"(?i)\bunit\b|\barea\b"), "Which unit or area did this happen in?")
    ask = ask.otherwise("Can you be more specific? Multiple activities match.")
    return F.concat(ask, F.lit("\nPossible matches:\n  - "), F.array_join(F.slice(names, 1, 3), "\n  - "))


def confirmed(confidence: Column) -> Column:
    """The confidence of a report of which a missing field was filled by an answer."""
    return F.least(confidence + CONFIRMED, F.lit(MOST))


def risk_or_low(level: Column) -> Column:
    """The risk of an activity in capitals, LOW where none is known."""
    return F.upper(F.coalesce(F.nullif(level, F.lit("")), F.lit("LOW")))
