"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lanewise.llm import (
    filteraudit, interpolation, leaks, licenses, neardups, packing, repeats, sentencepieces,
    sharding, tokencounts, topk, toxicity, vectorcodes,
)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardups.classes(_read(spark, sf_dir, "documents"), words=4, numerator=80)
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op2_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digests(packing.packed(_read(spark, sf_dir, "documents")))


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings")
    return topk.search(vectors, vectors.where(F.col("vec_id") % 100 == 0), k=10, scale=1024)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, _read(spark, sf_dir, "labels")))


def op5_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(_read(spark, sf_dir, "documents"))


def op6_interpolated_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolation.score(_read(spark, sf_dir, "documents"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.digests(_read(spark, sf_dir, "documents"))


def op8_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.find(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_read(spark, sf_dir, "documents")).drop("spans")


def op10_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove(_read(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.codes(_read(spark, sf_dir, "embeddings"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.count(_read(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audit(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (
    op1_near_duplicates, op2_packed_ids, op3_exact_top_k, op4_toxicity, op5_histogram_shards,
    op6_interpolated_lm, op7_sentencepiece, op8_benchmark_leaks, op9_license_scan, op10_repeated_passages,
    op11_vector_codes, op12_token_counts, op13_filter_audit)}


def _codes_sql() -> str:
    """Three assignments and two refinements of the codebooks, one after another."""
    rounds = ""
    for i in range(3):
        rounds += f""", a{i} as materialized (
            select p.r, p.j, min(d * 64 + e) % 64 as e, min(d * 64 + e) // 64 as d
            from (select p.r, p.j, b.e, list_sum(list_transform(list_zip(p.x, b.x), lambda q: (q[1] - q[2]) * (q[1] - q[2]))) as d
                  from parts p join b{i} b on p.j = b.j) p
            group by p.r, p.j)"""
        if i < 2:
            rounds += f""", m{i} as (
                select j, e, list(c order by place) as x
                from (select a.j, a.e, t.place, cast(floor(sum(p.x[t.place]) / count(*)) as bigint) as c
                      from a{i} a join parts p on a.r = p.r and a.j = p.j
                      join (select unnest(range(1, 100000)) as place) t on t.place <= len(p.x)
                      group by a.j, a.e, t.place)
                group by j, e), b{i + 1} as materialized (
                select b.j, b.e, coalesce(m.x, b.x) as x from b{i} b left join m{i} m on b.j = m.j and b.e = m.e)"""
    return f"""
        with v as materialized (
            select row_number() over () as r, vec_id, label,
                   list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as x
            from embeddings
            where embedding is not null and len(embedding) > 0 and len(embedding) % 16 = 0
              and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ), parts as materialized (
            select r, j, x[j * (len(x) // 16) + 1 : (j + 1) * (len(x) // 16)] as x
            from v, (select unnest(range(16)) as j)
        ), first as (
            select r, row_number() over (order by vec_id nulls last, x) - 1 as e from v
        ), b0 as materialized (
            select p.j, f.e, p.x from parts p join first f on p.r = f.r where f.e < 64
        ){rounds}, coded as (
            select v.vec_id, v.label, string_agg(printf('%02x', cast(a.e as integer)), '' order by a.j) as code,
                   cast(sum(a.d) as bigint) as error
            from a2 a join v on a.r = v.r group by v.r, v.vec_id, v.label
        )
        select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error,
               (select sha256(string_agg(array_to_string(x, ','), ',' order by j, e)) from b2) as codebooks_sha256
        from coded
    """


_AUDIT_SQL = """
    with d as (
        select doc_id, coalesce(source, '') as part, coalesce(text, '') as text,
               regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as words
        from documents
    ), l as (
        select doc_id, max(case when quality = 1 then 1 else 0 end) as good,
               max(case when toxic = 1 then 1 else 0 end) as toxic
        from labels group by doc_id
    ), f as materialized (
        select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
               cast(len(words) < 50 as integer) as a,
               cast(100 * len(list_distinct(words)) < 65 * len(words) as integer) as b,
               cast(100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text) as integer) as c,
               cast(regexp_matches(text, '[#$%&*|]') as integer) as d,
               cast(coalesce(min(d.doc_id) over (partition by text) < d.doc_id, false) as integer) as e
        from d left join l on d.doc_id = l.doc_id
    ), masks as materialized (
        select part, [a, b, c, d, e] as fails, count(*) as n, sum(good) as good, sum(toxic) as toxic
        from f group by all
    ), orders as (
        select x.i as i1, y.i as i2, z.i as i3, u.i as i4, w.i as i5
        from range(1, 6) x(i), range(1, 6) y(i), range(1, 6) z(i), range(1, 6) u(i), range(1, 6) w(i)
        where len(list_distinct([x.i, y.i, z.i, u.i, w.i])) = 5
    ), steps as materialized (
        select [i1, i2, i3, i4, i5] as way, step,
               'ABCDE'[i1] || 'ABCDE'[i2] || 'ABCDE'[i3] || 'ABCDE'[i4] || 'ABCDE'[i5] as filter_order
        from orders, range(1, 6) s(step)
    ), counted as (
        select part, filter_order, step, way[step] as own,
               sum(case when before = 0 and not hit then n else 0 end) as kept,
               sum(case when before = 0 and hit then n else 0 end) as removed,
               sum(case when before > 0 and hit then n else 0 end) as redundant,
               sum(case when hit and list_sum(fails) = 1 then n else 0 end) as unique_fails,
               sum(case when before = 0 and hit then good else 0 end) as good_lost,
               sum(case when before = 0 and hit then toxic else 0 end) as toxic_lost
        from (select *, fails[way[step]] = 1 as hit,
                     coalesce(list_sum(list_transform(way[1 : step - 1], lambda i: fails[i])), 0) as before
              from masks, steps)
        group by part, filter_order, step, way
    )
    select part, filter_order, cast(step as integer) as step, cast(kept as bigint) as kept,
           cast(removed as bigint) as removed, cast(redundant as bigint) as redundant,
           cast(unique_fails as bigint) as unique_fails, cast(good_lost as bigint) as good_lost,
           cast(toxic_lost as bigint) as toxic_lost,
           cast(sum(removed) over (partition by part, own) as bigint) as shapley
    from counted
"""

ORACLE_SQL: dict[str, str] = {
    "op3_exact_top_k": """
        with v as (
            select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as y
            from embeddings
            where vec_id is not null and embedding is not null
              and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ), s as (
            select q.vec_id as query_id, c.vec_id,
                   cast(list_sum(list_transform(list_zip(q.y, c.y), lambda p: p[1] * p[2])) as bigint) as score
            from v q join v c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id and len(q.y) = len(c.y)
        )
        select query_id, cast(rank as integer) as rank, vec_id, score
        from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
        where rank <= 10
    """,
    "op11_vector_codes": _codes_sql(),
    "op13_filter_audit": _AUDIT_SQL,
}
