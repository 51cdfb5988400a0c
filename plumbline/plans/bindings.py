"""The domain's tables, read off the driver's tables by fixed analogies.

An order is a planned activity of 30 days in its customer's segment (discipline) and nation (location); its last line
shipped is its finish. A line is a history record; an event is a claim about the activity of its user's number; regions,
nations and suppliers are a tree; parts form a precedence graph in which part k leads to 2k and 2k+1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.session import table

PLANNED_DAYS = 30


def activities(spark: SparkSession, d: str) -> DataFrame:
    o, c, n = table(spark, d, "orders"), table(spark, d, "customer"), table(spark, d, "nation")
    start = F.to_date("o_orderdate")
    return o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).select(
        F.col("o_orderkey").alias("activity_id"), start.alias("planned_start"), F.date_add(start, PLANNED_DAYS).alias("planned_finish"),
        F.col("c_mktsegment").alias("discipline"), F.col("n_name").alias("location"), F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("value"),
    )


def actuals(spark: SparkSession, d: str) -> DataFrame:
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    last = li.groupBy("l_orderkey").agg(F.max(F.to_date("l_shipdate")).alias("last"))
    status = F.when(F.col("o_orderstatus") == "F", "COMPLETED").when(F.col("o_orderstatus") == "P", "IN_PROGRESS").otherwise("NOT_STARTED")
    out = o.join(last, o.o_orderkey == last.l_orderkey, "left")
    return out.select(F.col("o_orderkey").alias("activity_id"), status.alias("status"), F.when(status == "COMPLETED", F.col("last")).alias("actual_finish"))


def history(spark: SparkSession, d: str) -> DataFrame:
    li, o, p = table(spark, d, "lineitem"), table(spark, d, "orders"), table(spark, d, "part")
    days = F.datediff(F.to_date("l_shipdate"), F.to_date("o_orderdate"))
    late = days > PLANNED_DAYS
    quality = F.when(F.col("l_returnflag") == "A", "verified").when(F.col("l_returnflag") == "N", "provisional").otherwise("rejected")
    return li.join(o, li.l_orderkey == o.o_orderkey).join(p, li.l_partkey == p.p_partkey).where(days >= 0).select(
        F.col("p_type").alias("discipline"), F.col("p_brand").alias("activity_type"), F.lit(PLANNED_DAYS).alias("planned_days"), days.alias("actual_days"),
        (days - PLANNED_DAYS).alias("variance_days"), late.alias("delayed"), F.when(late, F.col("o_orderpriority")).alias("delay_cause"),
        F.col("l_quantity").alias("productivity"), quality.alias("record_quality"),
    )


def claims(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    t = F.col("event_type")
    status = F.when(t == "purchase", "COMPLETED").when(t == "click", "IN_PROGRESS").when(t == "view", "NOT_STARTED").when(t == "error", "ON_HOLD")
    source = F.pmod(F.get_json_object("props", "$.k").cast("long"), F.lit(3)).cast("int")
    return e.select(
        F.col("user_id").alias("activity_id"), "event_id", F.col("event_id").alias("seq"), "ts", F.to_date("ts").alias("event_date"), source.alias("source"), status.alias("status"), "value", t.alias("stage")
    )


def tree(spark: SparkSession, d: str) -> DataFrame:
    r, n, s = table(spark, d, "region"), table(spark, d, "nation"), table(spark, d, "supplier")
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    none = F.lit(None).cast("string")
    return (
        r.select(key("r", "r_regionkey").alias("node"), none.alias("parent"), F.col("r_name").alias("name"), F.col("r_name").alias("zone"))
        .unionByName(n.select(key("n", "n_nationkey").alias("node"), key("r", "n_regionkey").alias("parent"), F.col("n_name").alias("name"), none.alias("zone")))
        .unionByName(s.select(key("s", "s_suppkey").alias("node"), key("n", "s_nationkey").alias("parent"), F.col("s_name").alias("name"), none.alias("zone")))
    )


def precedence(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("k")).where("k >= 1")
    both = p.select(F.col("k").alias("src"), F.explode(F.array(F.col("k") * 2, F.col("k") * 2 + 1)).alias("dst"))
    return both.join(p.select(F.col("k").alias("dst")), "dst", "left_semi")


#: The same tables as SQL common table expressions.
SQL = """
activities as (select o_orderkey as activity_id, cast(o_orderdate as date) as planned_start, cast(o_orderdate as date) + 30 as planned_finish,
  c_mktsegment as discipline, n_name as location, o_orderpriority as priority, o_totalprice as value
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey),
actuals as (select o_orderkey as activity_id, case o_orderstatus when 'F' then 'COMPLETED' when 'P' then 'IN_PROGRESS' else 'NOT_STARTED' end as status,
  case when o_orderstatus = 'F' then last end as actual_finish
  from orders left join (select l_orderkey, max(cast(l_shipdate as date)) as last from lineitem group by 1) on o_orderkey = l_orderkey),
history as (select p_type as discipline, p_brand as activity_type, 30 as planned_days, days as actual_days, days - 30 as variance_days, days > 30 as delayed,
  case when days > 30 then o_orderpriority end as delay_cause, l_quantity as productivity,
  case l_returnflag when 'A' then 'verified' when 'N' then 'provisional' else 'rejected' end as record_quality
  from (select *, date_diff('day', cast(o_orderdate as date), cast(l_shipdate as date)) as days from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey) where days >= 0),
claims as (select user_id as activity_id, event_id, event_id as seq, ts, cast(ts as date) as event_date, cast(((cast(props->>'$.k' as bigint) % 3) + 3) % 3 as int) as source,
  case event_type when 'purchase' then 'COMPLETED' when 'click' then 'IN_PROGRESS' when 'view' then 'NOT_STARTED' when 'error' then 'ON_HOLD' end as status, value, event_type as stage from events),
tree as (select 'r' || r_regionkey as node, null as parent, r_name as name, r_name as zone from region
  union all select 'n' || n_nationkey, 'r' || n_regionkey, n_name, null from nation
  union all select 's' || s_suppkey, 'n' || s_nationkey, s_name, null from supplier),
precedence as (select a.p_partkey as src, b.p_partkey as dst from part a join part b on a.p_partkey >= 1 and b.p_partkey // 2 = a.p_partkey)
"""
