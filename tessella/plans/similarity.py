"""Retrieval, related pages and their upkeep on the table of vectors.

Queries are the rows whose id is divisible by 100; the pool is the whole table. The threshold is 0.3, as the driver's
random vectors are seldom nearer; the engine's default is in operators.vectors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import related, vectors
from tessella.plans.tables import table

LEAST = 0.3


def _pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))


def _queries(pool: DataFrame) -> DataFrame:
    return pool.where("id % 100 = 0")


def topk_context_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = _pool(spark, sf_dir)
    return vectors.top_k(_queries(pool), pool).withColumn("rank", F.col("rank").cast("long"))


def related_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = _pool(spark, sf_dir)
    n = pool.count()
    links = _queries(pool).select(F.col("id").alias("query"), F.pmod(F.col("id") * 7 + 3, F.lit(n)).alias("id"))
    return vectors.related(_queries(pool), pool, links, least=LEAST).withColumn("rank", F.col("rank").cast("long"))


def related_maintenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = _pool(spark, sf_dir)
    n = pool.count()
    pages = pool.withColumn("current", F.when(F.col("id") % 3 != 0, F.pmod(F.col("id") * 13 + 1, F.lit(n + 5))))
    links = pool.select(F.col("id").alias("query"), F.pmod(F.col("id") * 7 + 3, F.lit(n)).alias("id"))
    return related.maintenance(pages, _queries(pool).select("id"), links, least=LEAST)


def strong_overlap_unhandled(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = _pool(spark, sf_dir)
    hits = vectors.top_k(_queries(pool), pool)
    best = hits.where("rank = 1")
    action = F.element_at(F.array(F.lit("create"), F.lit("update"), F.lit("noop")), (F.floor(F.col("query") / 100) % 3 + 1).cast("int"))
    decisions = best.select("query", action.alias("action"), F.when(F.col("query") % 200 == 0, F.col("id")).alias("target"))
    return vectors.strong_overlaps(hits, decisions, least=LEAST)


def vector_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = _pool(spark, sf_dir)
    new = pool.where("id % 10 = 0").select("id", F.reverse("vector").alias("vector"))
    # every component with its place, in millionths
    checksum = F.aggregate(F.transform("vector", lambda x, i: F.floor(x * 1_000_000) * (i + 1)), F.lit(0).cast("long"), lambda s, x: s + x)
    return vectors.pool_after(pool, new).select("id", F.size("vector").cast("long").alias("n"), checksum.alias("checksum"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (topk_context_retrieval, related_selection, related_maintenance, strong_overlap_unhandled, vector_pool)
}

_SCORED = """v as (select vec_id as id, embedding::double[] as vector from embeddings),
q as (select * from v where id % 100 = 0),
raw as (select q.id as query, v.id, greatest(0, least(1, list_dot_product(q.vector, v.vector))) as raw from q, v where q.id <> v.id),
s as (select query, id, raw, round(raw, 4) as score from raw)"""
_TOP = f"""{_SCORED},
t as (select query, id, score, row_number() over (partition by query order by score desc, id) as rank from s)"""
ORACLES = {
    "topk_context_retrieval": f"with {_TOP} select query, id, score, rank from t where rank <= {vectors.TOP_K}",
    "related_selection": f"""with {_SCORED}, n as (select count(*) as n from v),
m as (select s.*, s.id = (s.query * 7 + 3) % n.n as linked from s, n where score > {LEAST}),
r as (select *, row_number() over (partition by query, linked order by score desc, id) as k from m)
select query, id, score, case when linked then 'already_body_link' when k <= {vectors.RELATED_TOP_K} then 'kept' else 'cutoff' end as decision,
  case when not linked then k end as rank from r""",
    "related_maintenance": f"""with {_SCORED}, n as (select count(*) as n from v),
p as (select v.id, vector, case when v.id % 3 <> 0 then (v.id * 13 + 1) % (n.n + 5) end as current, (v.id * 7 + 3) % n.n as link from v, n),
old as (select * from p where id % 100 <> 0),
a as (select * from old where id in (select id from s where raw >= {LEAST}) or current in (select id from q)),
c as (select a.id, v.id as candidate, round(greatest(0, least(1, list_dot_product(a.vector, v.vector))), 4) as score from a, v where a.id <> v.id and v.id <> a.link),
b as (select id, candidate, score from (select *, row_number() over (partition by id order by score desc, candidate) as k from c where score > {LEAST}) where k = 1),
j as (select a.id, a.current, case when t.id is not null then greatest(0, least(1, list_dot_product(a.vector, t.vector))) end as cs, b.candidate, b.score,
  t.id is null or a.current = a.link as invalid from a left join b on a.id = b.id left join v t on t.id = a.current)
select id, current, round(cs, 4) as current_score, candidate, score as candidate_score,
  case when candidate is null then case when current is not null and invalid then 'remove' else 'keep_no_candidate' end
       when current is null then 'add' when current = candidate then 'keep_existing' when invalid then 'replace'
       when score >= cs + {vectors.REPLACE_MARGIN} then 'replace' else 'keep_existing' end as action from j""",
    "strong_overlap_unhandled": f"""with {_TOP}, b as (select * from t where rank = 1)
select query, id, score from b where score >= {LEAST} and not ((query // 100) % 3 in (1, 2) and query % 200 = 0)""",
    "vector_pool": """with p as (select vec_id as id, case when vec_id % 10 = 0 then list_reverse(embedding) else embedding end::double[] as v from embeddings)
select id, len(v)::bigint as n, list_sum(list_transform(v, lambda x, i: (floor(x * 1000000)::bigint * i)::hugeint))::bigint as checksum from p""",
}
