"""The queries opN_<name> of this subpackage, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import bpe, chat, codes, context_tree, exact_dedup, filter_audit, jaccard, licenses, packing, sharding, topk, toxicity, url_filter
from plumbline.llm.shared import LOWER, UPPER

SHARDS = 40


def vocabulary_file(name: str) -> str:
    """Where a public vocabulary lies; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(read(spark, sf_dir, "documents"), width=3, percent=90)


CATEGORIES = ["low_quality", "toxic"]


def toxicity_chain(docs: DataFrame, sf_dir: str) -> toxicity.ToxicityChain:
    labels = read(docs.sparkSession, sf_dir, "labels").withColumn("low_quality", 1 - F.col("quality"))
    return toxicity.fit_chain(docs, labels, CATEGORIES)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.judge(docs, toxicity_chain(docs, sf_dir))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_by_size(read(spark, sf_dir, "documents"), SHARDS)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read(spark, sf_dir, "documents"), keep="largest")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_and_decode(read(spark, sf_dir, "documents"), vocabulary_file("word_bpe_49k.json"), steady=True)


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topk.stored(topk.whole_numbers(read(spark, sf_dir, "embeddings")), "top-vectors")
    return topk.exact_top_k(rows.where("id % 50 = 0"), rows, 5)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licences(read(spark, sf_dir, "documents"), licenses.known_licences(spark))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results, needs = chat.conversation_calls(read(spark, sf_dir, "conversations"))
    return chat.link_tools(calls, results, chat.REPLY, needs)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), vocabulary_file("byte_bpe_50k.json"), end_id=0, length=1024)


# The rules of the address filter (verdict, host, path).
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(read(spark, sf_dir, "pages"), URL_RULES)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, books = codes.compress(read(spark, sf_dir, "embeddings"))
    digest = F.lit(books.sha256() if books else None).cast("string")
    return codes.label_errors(rows).select(F.col("id").alias("vec_id"), "code", "error", "label_error", digest.alias("codebooks_sha256"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = filter_audit.failed_sets(read(spark, sf_dir, "documents"))
    return filter_audit.audit(filter_audit.set_counts(sets, read(spark, sf_dir, "labels")))


def op13_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tree.score(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_toxicity": op2_toxicity,
    "op3_sharding": op3_sharding,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_bpe": op5_bpe,
    "op6_exact_topk": op6_exact_topk,
    "op7_license_scan": op7_license_scan,
    "op8_chat_format": op8_chat_format,
    "op8_chat_levels": op8_chat_format,  # the former name of the form with levels
    "op9_packing": op9_packing,
    "op10_url_filter": op10_url_filter,
    "op11_vector_codes": op11_vector_codes,
    "op12_filter_audit": op12_filter_audit,
    "op13_lm_score": op13_lm_score,
}


def codes_sql(parts: int, entries: int, rounds: int) -> str:
    """Codes by plain rescans: every part against every entry in every round."""
    steps, last = [], "c0"
    near = """select p.rid, p.part, min_by(c.entry, (list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), c.entry)) as entry,
       min(list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) as d
       from p join {last} c using (part) group by p.rid, p.part"""
    for t in range(rounds):
        steps.append(f"""a{t} as materialized ({near.format(last=last)}),
m{t} as (select part, entry, list(m order by pos) as x from (
   select a.part, a.entry, i.pos, cast((sum(p.x[i.pos]) - ((sum(p.x[i.pos]) % count(*)) + count(*)) % count(*)) // count(*) as bigint) as m
   from a{t} a join p using (rid, part), (select unnest(range(1, (select max(len(x)) from p) + 1)) as pos) i group by a.part, a.entry, i.pos) group by part, entry),
c{t + 1} as materialized (select c.part, c.entry, coalesce(m.x, c.x) as x from {last} c left join m{t} m using (part, entry)),""")
        last = f"c{t + 1}"
    return f"""
with v as materialized (select row_number() over (order by vec_id nulls last, embedding) as rid, vec_id, label,
        list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
   from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as materialized (select rid, part, v[part * (len(v) // {parts}) + 1 : (part + 1) * (len(v) // {parts})] as x from v, (select unnest(range({parts})) as part)),
c0 as materialized (select part, rid - 1 as entry, x from p where rid <= {entries}),
{"".join(steps)}
f as materialized ({near.format(last=last)}),
o as (select rid, string_agg(printf('%02x', entry), '' order by part) as code, cast(sum(d) as bigint) as error from f group by rid),
l as (select label, sum(error) as label_error from o join v using (rid) group by label)
select v.vec_id, o.code, o.error, cast(l.label_error as bigint) as label_error,
   (select sha256(string_agg(array_to_string(x, ','), ',' order by part, entry)) from {last}) as codebooks_sha256
from v join o using (rid) join l on v.label is not distinct from l.label
"""


AUDIT_SQL = """
with t as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t from documents),
w as (select *, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as ws,
        length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) as capitals, min(doc_id) over (partition by t) as least from t),
m as (select doc_id, part, (len(ws) < 200)::int + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::int + 4 * (100 * capitals > 2 * length(t))::int
        + 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * coalesce(doc_id > least, false)::int as mask from w),
l as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by doc_id),
c as materialized (select part, mask, count(*) as n, coalesce(sum(good), 0) as good, coalesce(sum(toxic), 0) as toxic from m left join l using (doc_id) group by part, mask),
f as (select * from (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) x(f, b)),
o as (select a.f || b.f || c.f || d.f || e.f as filter_order, [a.b, b.b, c.b, d.b, e.b] as bits from f a, f b, f c, f d, f e where a.b | b.b | c.b | d.b | e.b = 31),
s as materialized (select filter_order, step, bits[step] as bit, list_sum(bits[1 : step - 1]) as earlier from o, (select unnest(range(1, 6)) as step)),
r as (select part, filter_order, cast(step as int) as step, bit,
        sum(n) filter (where mask & (bit | coalesce(earlier, 0)::int) = 0) as kept,
        sum(n) filter (where mask & bit <> 0 and mask & coalesce(earlier, 0)::int = 0) as removed,
        sum(n) filter (where mask & bit <> 0 and mask & coalesce(earlier, 0)::int <> 0) as redundant,
        sum(n) filter (where mask = bit) as unique_fails,
        sum(good) filter (where mask & bit <> 0 and mask & coalesce(earlier, 0)::int = 0) as good_lost,
        sum(toxic) filter (where mask & bit <> 0 and mask & coalesce(earlier, 0)::int = 0) as toxic_lost
      from c, s group by part, filter_order, step, bit)
select part, filter_order, step, cast(coalesce(kept, 0) as bigint) as kept, cast(coalesce(removed, 0) as bigint) as removed, cast(coalesce(redundant, 0) as bigint) as redundant,
   cast(coalesce(unique_fails, 0) as bigint) as unique_fails, cast(coalesce(good_lost, 0) as bigint) as good_lost, cast(coalesce(toxic_lost, 0) as bigint) as toxic_lost,
   cast(sum(coalesce(removed, 0)) over (partition by part, bit) as bigint) as shapley
from r
"""

_FOLD = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
SQL: dict[str, str] = {
    "op4_exact_dedup": f"""
with t as (select doc_id, {_FOLD} as t from documents),
g as (select t, max(doc_id) as keep_id, count(*) as group_size from t group by t)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(t) as text_sha256 from t join g using (t)
""",
    "op6_exact_topk": """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v from embeddings
           where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as (select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) as bigint) as score
      from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score
from p qualify rank <= 5
""",
    "op7_license_scan": licenses.licence_sql(),
    "op8_chat_format": chat.levels_sql(),
    "op8_chat_levels": chat.levels_sql(),
    "op11_vector_codes": codes_sql(16, 64, 2),
    "op12_filter_audit": AUDIT_SQL,
}
