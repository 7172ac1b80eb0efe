"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import best_fit, byte_bpe, clustering, collocations, language, licenses, mixing, packing, repetition, sharding, simhash, token_counts, topk
from ._common import written


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_scores(_documents(spark, sf_dir), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2)


def op2_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.histogram_shards(_documents(spark, sf_dir), shards=24)
    crc = F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0))
    return placed.select("doc_id", "size", crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_documents(spark, sf_dir), vocabulary("piece_bpe_32k.model"))


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.quality_rules(_documents(spark, sf_dir)).drop("spans")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(_documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(_documents(spark, sf_dir)).drop("templates")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    held = language.held_out("doc_id")
    model = language.fit(docs.where(~held & F.col("doc_id").isNotNull()))
    found = language.predict(docs, model)
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "ambiguous")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.encode(_documents(spark, sf_dir), vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return topk.exact_top_k(vectors, vectors.where("vec_id % 50 = 0"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_documents(spark, sf_dir))


def op12_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.best_fit(_documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))


def op13_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned, centroids = clustering.lloyd(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    assigned = written(assigned, "assigned")
    total = assigned.agg(F.sum("distance").alias("inertia"))
    inertia = assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    digest = F.sha2(F.array_join(F.transform("centroid", lambda x: x.cast("string")), ","), 256)
    clusters = centroids.select("cluster", digest.alias("centroid_sha256")).join(inertia, "cluster").join(F.broadcast(total))
    # 40 rows, one for each cluster
    return assigned.join(F.broadcast(clusters), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


QUERIES = {
    "op1_context_mixing": op1_context_mixing,
    "op2_histogram_shards": op2_histogram_shards,
    "op3_token_counts": op3_token_counts,
    "op4_pack": op4_pack,
    "op5_quality_rules": op5_quality_rules,
    "op6_simhash": op6_simhash,
    "op7_license_scan": op7_license_scan,
    "op8_language": op8_language,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_top_k": op10_top_k,
    "op11_collocations": op11_collocations,
    "op12_best_fit": op12_best_fit,
    "op13_lloyd": op13_lloyd,
}


def _lloyd_sql(k: int = 40, rounds: int = 5) -> str:
    """Lloyd's rounds as one list of common table expressions, two for each round."""
    nearest = """
        select vec_id, v, c.cluster, d from (
            select v.vec_id, v.v, c.cluster, cast(list_sum(list_transform(list_zip(v.v, c.c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) as bigint) as d
            from v, {model} c
        ) c qualify row_number() over (partition by vec_id order by d, cluster) = 1"""
    parts = [f"""
        v as materialized (
            select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v from embeddings
            where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ),
        m0 as materialized (
            select cast(row_number() over (order by h) - 1 as int) as cluster, v as c
            from (select sha256('2:' || vec_id) as h, v from v order by h limit {k})
        )"""]
    for i in range(1, rounds + 1):
        parts.append(f"a{i} as materialized ({nearest.format(model=f'm{i - 1}')})")
        parts.append(f"""m{i} as materialized (
            select m.cluster, coalesce(new.c, m.c) as c from m{i - 1} m left join (
                select cluster, list(x order by place) as c from (
                    select cluster, place, cast((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) as bigint) as x
                    from (select cluster, unnest(v) as x, generate_subscripts(v, 1) as place from a{i}) group by cluster, place
                ) group by cluster
            ) new on m.cluster = new.cluster
        )""")
    parts.append(f"a as materialized ({nearest.format(model=f'm{rounds}')})")
    return f"""with {", ".join(parts)}
        select a.vec_id, a.cluster, a.d as distance, cast(sum(a.d) over (partition by a.cluster) as bigint) as cluster_inertia,
               cast(sum(a.d) over () as bigint) as inertia, sha256(array_to_string(m.c, ',')) as centroid_sha256
        from a join m{rounds} m on a.cluster = m.cluster"""


#: The others aren't expressible in SQL, or too slow on whole tables; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op10_top_k": """
        with v as (
            select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
            from embeddings
            where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ),
        s as (
            select q.vec_id as query_id, c.vec_id as vec_id,
                   cast(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) as bigint) as score
            from v q join v c on q.vec_id <> c.vec_id
            where q.vec_id % 50 = 0
        )
        select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score
        from s qualify rank <= 5
    """,
    "op11_collocations": r"""
        with pieces as (
            select lang, unnest(regexp_split_to_array(t, '[.,;:!?\n-\r]')) as p
            from (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents)
        ),
        words as (select lang, list_filter(regexp_split_to_array(p, '[ \t]+'), lambda x: x <> '') as w from pieces),
        totals as (select lang, cast(sum(len(w)) as bigint) as n from words group by lang),
        grams as (select lang, unnest(flatten(list_transform(range(1, 5), lambda k: list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])))) as w from words),
        f as materialized (select lang, w, count(*) as f from grams group by lang, w having count(*) >= 30),
        longer as (
            select lang, w, max(f) as most from (
                select lang, f, unnest(flatten(list_transform(range(2, len(w)), lambda k: list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])))) as w from f
            ) group by lang, w
        ),
        own as (select f.lang, f.w, f.f as a from f left join longer g on f.lang = g.lang and f.w = g.w where len(f.w) >= 2 and (g.most is null or 100 * g.most < 80 * f.f)),
        cuts as (select lang, w, a, unnest(range(1, len(w))) as k from own),
        scored as (
            select c.lang, c.w, c.a, c.k, x.f as l, y.f as r, cast((2000000 * cast(c.a as hugeint)) // (x.f + y.f) as bigint) as score
            from cuts c join f x on c.lang = x.lang and x.w = c.w[1:c.k] join f y on c.lang = y.lang and y.w = c.w[c.k + 1:]
        ),
        best as (select lang, array_to_string(w, ' ') as phrase, a, l, r, score from scored qualify row_number() over (partition by lang, w order by score, k) = 1)
        select best.lang, cast(row_number() over (partition by best.lang order by score desc, a desc, phrase) as bigint) as rank, phrase, a, l, r, n, score
        from best join totals on best.lang = totals.lang qualify rank <= 2000
    """,
    "op13_lloyd": _lloyd_sql(),
}
