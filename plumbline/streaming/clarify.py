"""Questions that wait for answers: one open question a report, answered, replaced or given up in event time.

messages: key, seq, ts, kind ("question" or "answer"), text. A question opens; the next question of its key replaces it; an
answer within the patience closes it; without one it expires. An answer to nothing open is unasked. The batch form reads
each message beside its neighbours in the order of (key, ts, seq), by a scan that splits a key with many messages; the
streaming form keeps the open question of each key and a timer in event time, and no messages.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from plumbline.operators.scan import following, previous, scanned

OUTCOMES = "key {key}, question_seq long, outcome string, answer_seq long, answer string, waited long"


def clarifications(messages: DataFrame, patience: int, now=None) -> DataFrame:
    """(key, question_seq, outcome, answer_seq, answer, waited): one row for each question, and one for each unasked answer.

    patience is in seconds, and an answer that comes just then still counts. outcome: answered, superseded, expired, or,
    where the patience lasts beyond `now`, open; waited: seconds from the question to its answer. Messages of other kinds
    are left out. A null key is a key like others; (key, ts, seq) has to be unique.
    """
    m = messages.where(F.col("kind").isin("question", "answer")).select("key", F.col("seq").cast("long").alias("seq"), "ts", "kind", "text")
    own = F.struct("key", "seq", "ts", "kind", "text")
    m = scanned(m, ["key", "ts", "seq"], nxt=following(own), prv=previous(own))
    gap = lambda a, b: F.unix_timestamp(a) - F.unix_timestamp(b)
    asked, same_next, same_before = F.col("kind") == "question", F.col("nxt.key").eqNullSafe(F.col("key")) & F.col("nxt").isNotNull(), F.col("prv.key").eqNullSafe(F.col("key")) & F.col("prv").isNotNull()
    soon = same_next & (gap(F.col("nxt.ts"), F.col("ts")) <= patience)
    closed = same_before & (F.col("prv.kind") == "question") & (gap(F.col("ts"), F.col("prv.ts")) <= patience)
    still = F.lit(False) if now is None else gap(F.lit(now).cast("timestamp"), F.col("ts")) <= patience
    outcome = F.when(~asked, "unasked").when(soon & (F.col("nxt.kind") == "answer"), "answered").when(soon, "superseded").when(still, "open").otherwise("expired")
    m = m.where(asked | ~F.coalesce(closed, F.lit(False))).withColumn("outcome", outcome)
    answered = F.col("outcome") == "answered"
    return m.select(
        "key", F.when(asked, F.col("seq")).alias("question_seq"), "outcome", F.when(~asked, F.col("seq")).when(answered, F.col("nxt.seq")).alias("answer_seq"),
        F.when(~asked, F.col("text")).when(answered, F.col("nxt.text")).alias("answer"), F.when(answered, gap(F.col("nxt.ts"), F.col("ts"))).alias("waited"),
    )


class Waiting(StatefulProcessor):
    """The open question of a key and the timer of its patience."""

    def __init__(self, patience: int):
        self.patience = patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "seq long, asked long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        row = lambda q, what, s, text, waited: out.append((key[0], q, what, s, text, waited))
        held = self.open.get() if self.open.exists() else None
        for r in pd.concat(list(rows)).sort_values(["ts", "seq"]).itertuples():
            at = pd.Timestamp(r.ts).value // 1_000_000
            if held and at - held[1] > 1000 * self.patience:
                row(held[0], "expired", None, None, None)
                self.handle.deleteTimer(held[1] + 1000 * self.patience)
                held = None
            if r.kind == "question":
                if held:
                    row(held[0], "superseded", None, None, None)
                    self.handle.deleteTimer(held[1] + 1000 * self.patience)
                held = (int(r.seq), at)
                self.handle.registerTimer(at + 1000 * self.patience)
            elif held:
                row(held[0], "answered", int(r.seq), r.text, (at - held[1]) // 1000)
                self.handle.deleteTimer(held[1] + 1000 * self.patience)
                held = None
            else:
                row(None, "unasked", int(r.seq), r.text, None)
        if held:
            self.open.update(held)
        elif self.open.exists():
            self.open.clear()
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.open.exists():
            held = self.open.get()
            if held[1] + 1000 * self.patience <= expiredTimerInfo.getExpiryTimeInMs():
                self.open.clear()
                yield self._frame([(key[0], held[0], "expired", None, None, None)])

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["key", "question_seq", "outcome", "answer_seq", "answer", "waited"])
        return out.astype({c: "Int64" for c in ("question_seq", "answer_seq", "waited")})

    def close(self) -> None:
        pass


def follow_clarifications(messages: DataFrame, patience: int, watermark: str = "1 minute") -> DataFrame:
    """The streaming form: the rows of clarifications() as they are settled, in append mode.

    Needs the RocksDB state store. Rows of a key have to come in the order of ts within the watermark; a question expires
    once the watermark has passed its patience.
    """
    m = messages.where(F.col("kind").isin("question", "answer")).withWatermark("ts", watermark)
    kind = dict(messages.dtypes)["key"]
    return m.groupBy("key").transformWithStateInPandas(Waiting(patience), OUTCOMES.format(key=kind), "Append", "EventTime")


def rematched(outcomes: DataFrame, activities: DataFrame) -> DataFrame:
    """Answered questions with the activity that the answer names, if it is one's id or begins with an id and a blank.

    An answer that names none fills the field that was asked for; it is given as `filled`. activities: activity_id, as text.
    """
    first = F.split(F.trim("answer"), " ").getItem(0)
    said = outcomes.where("outcome = 'answered'").withColumn("named", first)
    known = activities.select(F.col("activity_id").alias("named"), F.col("activity_id").alias("resolved")).dropDuplicates(["named"])
    out = said.join(known, "named", "left")
    return out.select("key", "question_seq", "answer_seq", "waited", F.col("resolved").alias("activity_id"), F.when(F.col("resolved").isNull(), F.trim("answer")).alias("filled"))
