"""The hybrid matcher, its index and its questions against plain loops; trees from dotted codes."""

import math
import random
import re
from collections import Counter
from datetime import date, timedelta
from difflib import SequenceMatcher

import pytest

from plumbline.operators import graph as G
from plumbline.operators import linking as K
from plumbline.plans import registry

SF = "/root/testdata/sf0.001"
EVENT = "event_id long, event_text string, discipline string, location string, event_date date, source string, status_hint string"
ACTIVITY = "activity_id long, activity_name string, discipline string, location string, wbs_id string, planned_start date, planned_finish date, predecessors array<long>"
IDS = re.compile(r"\b[A-Z]+-\d+\b|\bLine\s+\d+\b|\bUnit\s+\d+\b|\bArea\s+[A-Z]\b", re.I)


def plain_terms(t):
    w = re.findall(r"\b\w\w+\b", t.lower())
    return w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]


def weighed(texts):
    df = Counter(x for t in texts.values() for x in set(plain_terms(t)))
    idf = {x: math.log((1 + len(texts)) / (1 + n)) + 1 for x, n in df.items()}

    def vector(t):
        v = {x: n * idf[x] for x, n in Counter(plain_terms(t)).items() if x in idf}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {x: y / norm for x, y in v.items()} if norm else {}

    return vector


def plain_match(events, activities, completed, feedback=()):
    names = {a[0]: " ".join(x for x in (a[1], a[2], a[3], a[4]) if x) for a in activities}
    vector = weighed(names)
    vectors = {i: vector(t) for i, t in names.items()}
    out, hits = {}, Counter()
    for i, text, disc, place, day, _, _ in events:
        q = vector(text)
        score = {a: sum(q.get(x, 0) * w for x, w in v.items()) for a, v in vectors.items()}
        top = sorted(score, key=lambda a: (-round(score[a], 8), a))[:10]
        rows = []
        for place_no, k in enumerate(top):
            a = next(x for x in activities if x[0] == k)
            found = IDS.findall(text)
            tags = [x for x in found if re.match(r"^[A-Za-z]+-\d+$", x)]
            s = {
                "identifier": 0.2 * any(x.upper() in a[1].upper() for x in found),
                "discipline": 0.15 * bool(disc and disc.lower() == (a[2] or "").lower()),
                "location": 0.1 * bool(place and place.lower() in (a[3] or "").lower()),
                "wbs": 0.05 * bool(a[4] and any(a[4].upper().startswith(re.match("[A-Za-z]+", x)[0].upper()[:3]) for x in tags)),
                "temporal": 0.0,
            }
            if day and a[5]:
                s["temporal"] = 0.05 if a[5] <= day <= a[6] else 0.02 if min(abs((day - a[5]).days), abs((day - a[6]).days)) <= 7 else 0.0
            preds = set(a[7] or [])
            s["dependency"] = 0.03 if not preds else 0.05 if preds <= completed else 0.02 if preds & completed else 0.0
            said = [0.1 * r for x, t, ok in feedback if ok and x == k and (r := SequenceMatcher(None, text.lower(), t.lower()).ratio()) > 0.6]
            s["feedback"] = round(max(said), 4) if said else 0.0
            hits.update({(n, v > 0) for n, v in s.items()})
            rows.append((min(1.0, score[k] + sum(s.values())), place_no, k, [n for n, v in s.items() if v > 0]))
        rows.sort(key=lambda r: (-round(r[0], 8), r[1]))
        unclear = len(text.split()) <= 6 and not IDS.search(text) and len(rows) > 1 and rows[0][0] - rows[1][0] < 0.08
        s = rows[0][0]
        out[i] = (None if unclear else rows[0][2], s, "clarification_needed" if unclear else "auto_linked" if s >= 0.85 else "pending_review" if s >= 0.65 else "unmatched", [(r[2], r[0], r[3]) for r in rows[:3]])
    return out, hits


def test_hybrid_match(spark):
    rnd = random.Random(11)
    verbs, things = ["Erect", "Weld", "Test", "Pull cable", "Paint"], ["spool", "pump", "tray", "valve"]
    acts = []
    for i in range(1, 41):
        start = date(2026, 8, 1) + timedelta(days=i)
        acts.append((i, f"{rnd.choice(verbs)} Line {i % 6} {rnd.choice(things)} {rnd.choice(['V', 'PIP'])}-{i % 9}", rnd.choice(["piping", "Civil", None]), rnd.choice(["Unit 3", "Area B", None]), rnd.choice(["PIP.1", "CIV.2", None, ""]), start if i % 4 else None, start + timedelta(days=5) if i % 4 else None, rnd.choice([[], None, [i - 1], [i - 1, i - 2]])))
    done = {i for i in range(40) if i % 3}
    evs = []
    for i in range(60):
        text = rnd.choice([f"{rnd.choice(verbs).lower()} of line {rnd.randrange(7)} {rnd.choice(things)} completed today at unit {rnd.randrange(4)}", f"PIP-{rnd.randrange(9)} done", "Erection completed", "", "nothing known at all, quite another matter here", "weld pump", acts[i % 40][1] + " finished"])
        evs.append((i, text, rnd.choice(["Piping", "civil", None, ""]), rnd.choice(["unit 3", "B", None]), date(2026, 8, 1) + timedelta(days=rnd.randrange(60)) if i % 5 else None, "s", "completed"))
    fed = [(a[0], a[1] + " finish", a[0] % 2 == 0) for a in acts[:30]]
    e, a = spark.createDataFrame(evs, EVENT), spark.createDataFrame(acts, ACTIVITY)
    c, f = spark.createDataFrame([(x,) for x in done], "activity_id long"), spark.createDataFrame(fed, "activity_id long, text string, approved boolean")
    want, hits = plain_match(evs, acts, done, fed)
    assert len(hits) == 14  # every signal is met on and off
    got = K.hybrid_match(e, a, c, feedback=f).collect()
    assert {r.decision for r in got} == {"clarification_needed", "auto_linked", "pending_review", "unmatched"} and len(got) == len(evs)
    for r in got:
        activity, score, decision, best = want[r.event_id]
        assert (r.activity_id, r.decision) == (activity, decision) and abs(r.confidence - score) < 6e-4 and (r.question is not None) == (decision == "clarification_needed")
        assert [(x.activity_id, [s.signal for s in x.evidence if s.matched][1:]) for x in r.candidates] == [(k, s) for k, _, s in best]
    linked = {r.event_id for r in got if r.decision == "auto_linked"}
    m = spark.createDataFrame(got)
    table = K.links(m, e)
    assert {r.event_id for r in table.collect()} == linked
    by = {r.activity_id: r.links for r in K.link_lookup(table, "activity_id").collect()}
    assert sum(map(len, by.values())) == len(linked) and K.link_lookup(table, "event_id", event_id=min(linked)).count() == 1
    assert K.hybrid_match(e.limit(0), a, c).count() == 0 and K.hybrid_match(e, a.limit(0), c).count() == 0


def test_events_of_any_shape(spark):
    raw = spark.createDataFrame([("1", None, "said", "other", "2026-08-01T10:00", None, "done"), ("2", "raw", "said", None, "no day", "file", None), (None, "", "", "last", None, None, "")], "event_id string, raw_text string, description string, event_text string, date string, source_id string, status_hint string")
    got = [tuple(r) for r in K.coalesced_events(raw).collect()]
    assert got == [("1", "said", None, None, date(2026, 8, 1), "unknown", "done"), ("2", "raw", None, None, None, "file", "unknown"), ("unknown", "last", None, None, None, "unknown", "unknown")]


def test_additions_equal_a_new_index(spark):
    texts = {i: " ".join(random.Random(i).choices(["pump", "line", "weld", "naïve", "unit", "x"], k=6)) for i in range(30)}
    df = lambda d: spark.createDataFrame(list(d.items()) or [], "id long, text string")
    index = K.term_index(df({i: t for i, t in texts.items() if i < 20}))
    changed = {3: "quite new words", 4: ""}
    index = index.add(df({i: t for i, t in texts.items() if i >= 20})).add(df(changed)).add(df({}))
    now = texts | changed
    vector = weighed(now)
    want = {(i, x): w for i, t in now.items() for x, w in vector(t).items()}
    got = {(r.id, r.token): r.weight for r in index.weights().collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    whole = {(r.id, r.token): r.weight for r in K.term_index(df(now)).weights().collect()}
    assert all(got[k] == pytest.approx(whole[k]) for k in whole)


def test_options(spark):
    acts = [(i, f"{'weld' if i % 3 else 'lift'} {i}", "Piping" if i % 2 else "civil", f"Unit {i % 4}") for i in range(40)]
    evs = [(1, ["asset"], "piping", None, None), (2, ["asset"], "piping", "unit 2", "weld"), (3, ["status", "asset"], None, "UNIT 1", "Lift"), (4, ["asset"], None, None, None), (5, ["status"], None, None, None), (6, ["discipline", "status"], None, None, None), (7, ["location"], "x", None, None), (8, [], None, None, None), (9, ["activity_type"], None, None, None), (10, ["asset"], "", "", "")]
    a = spark.createDataFrame(acts, "activity_id long, activity_name string, discipline string, location string")
    e = spark.createDataFrame(evs, "event_id long, missing array<string>, discipline string, location string, activity_type string")

    def plain(d, place, kind):
        fit = [x for x in acts if (not d or x[2].lower() == d.lower()) and (not place or place.lower() in x[3].lower()) and (not kind or kind.lower() in x[1].lower())]
        return [f"{x[0]} — {x[1]}" for x in (fit or acts)[:5]]

    want = {1: ("asset", plain("piping", None, None)), 2: ("asset", plain("piping", "unit 2", "weld")), 3: ("asset", plain(None, "unit 1", "lift")), 4: ("asset", plain(None, None, None)), 5: ("status", K.FIELD_OPTIONS["status"]), 6: ("discipline", K.FIELD_OPTIONS["discipline"]), 7: ("location", None), 9: ("detail", None), 10: ("asset", plain(None, None, None))}
    assert {r.event_id: (r.field, r.options) for r in K.clarification_options(e, a).collect()} == want
    fitting = {r.event_id: r.fitting for r in K.option_candidates(e.where("array_contains(missing, 'asset')"), a).collect()}
    assert fitting == {1: True, 2: False, 3: True, 4: True, 10: True}
    assert K.clarification_options(e, a.limit(0)).count() == 9 and K.clarification_options(e.limit(0), a).count() == 0


def test_registered_questions_meet_both_branches(spark):
    got = registry.QUERIES["clarification_options"](spark, SF)
    assert {r.field for r in got.select("field").distinct().collect()} == {"asset", "discipline", "status", "location"} and got.where("field = 'asset'").select("options").distinct().count() > 3


def test_wbs_nodes(spark):
    rows = [("1.2.3", "Leaf", None, None), ("1", "Plant", "piping", None), ("1.2.4", None, "civil", "Unit 9"), ("1.2.4", "Twice", None, "Unit 8"), ("7.1", "", None, None), (" ", "blank", None, None), (None, "none", None, None), ("1.2", None, None, "Area B")]
    got = {r.code: tuple(r)[1:] for r in G.wbs_nodes(spark.createDataFrame(rows, "code string, name string, discipline string, location string")).collect()}
    assert got == {
        "1": (None, "Plant", 1, "Plant", "piping", None, False), "1.2": ("1", "1.2", 2, "Plant > 1.2", "piping", "Area B", False), "1.2.3": ("1.2", "Leaf", 3, "Plant > 1.2 > Leaf", "piping", "Area B", False),
        "1.2.4": ("1.2", "Twice", 3, "Plant > 1.2 > Twice", "civil", "Unit 8", False), "7": (None, "7", 1, "7", None, None, True), "7.1": ("7", "7.1", 2, "7 > 7.1", None, None, False),
    }


def test_public_events(spark):
    t = spark.createDataFrame([(1, "rejected", None, 5, 0.4), (2, "approved", 6, 5, 0.9), (3, "auto_linked", None, 5, 0.9), (4, "superseded", 6, 5, 0.9), (5, "unmatched", None, None, 0.1)], "event_id long, link_state string, linked_activity_id long, matched_activity_id long, confidence double")
    a = spark.createDataFrame([(5, "five"), (6, "six"), (6, "six")], "activity_id long, activity_name string")
    got = {r.event_id: (r.matched_activity_id, r.matched_activity_name, r.proposed_activity_id) for r in K.public_events(t, a).collect()}
    assert got == {1: (None, None, 5), 2: (6, "six", 5), 3: (5, "five", 5), 4: (6, "six", 5), 5: (None, None, None)}


def test_terms_of_reports_are_not_shuffled(spark):
    index = K.term_index(spark.createDataFrame([(1, "pump set aligned"), (2, "pump set tested")], "id long, text string"))
    asked = index.asked(spark.createDataFrame([(k, f"pump set of unit {k}") for k in range(20)], "query long, text string"))
    plan = asked._jdf.queryExecution().executedPlan().toString()
    dealt = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    assert len(dealt) == 1 and "hashpartitioning(query" in dealt[0] and "token" not in dealt[0].split("REPARTITION")[0]
    assert {r.query for r in asked.collect()} == set(range(20)) and {r.token for r in asked.collect()} == {"pump", "set", "pump set"}
