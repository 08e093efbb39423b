"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.llm import ann, bpe, centroids, chat, exact_dedup, jaccard_join, language_model, mixing, simhash, suffix_dedup, toxicity, warc, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = warc.archived(table(spark, sf_dir, "pages"))
    page = lambda urn: F.regexp_extract(urn, r":capture:(-?\d+):", 1).try_cast("long")
    got = F.col("response")
    return captures.select(
        page(got.record_id).alias("page_id"),
        got.payload_bytes.alias("payload_bytes"),
        got.payload_digest.alias("payload_digest"),
        got.kind.alias("record_type"),
        page(F.coalesce(got.refers_to, F.lit(""))).alias("refers_to"),
    )


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mixture(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', '{odd}'), (-7L, 1L, 'assistant', '{odd}') AS t(conv_id, turn, role, text)")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digests(chat.windows(turns))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.cut_out(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.scored(table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.deduplicate(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe.encoded(docs, tokenizer_file(), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join.joined(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("size").alias("n_shingles"), "component_id")


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clustered(table(spark, sf_dir, "embeddings"))


def rounds_of_centroids(rounds: int = centroids.ROUNDS) -> str:
    """The clustering written out in SQL, two common table expressions a round."""
    steps = [
        """v AS (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS x FROM embeddings
        WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda c: isfinite(c::DOUBLE))) = 64)""",
        "c0 AS (SELECT row_number() OVER (ORDER BY h NULLS LAST, x) - 1 AS k, x FROM (SELECT sha256('2:' || vec_id) AS h, x FROM v ORDER BY h NULLS LAST, x LIMIT 40))",
    ]
    for i in range(rounds + 1):
        steps.append(
            f"""a{i} AS MATERIALIZED (SELECT r, any_value(vec_id) AS vec_id, any_value(x) AS x, min(struct_pack(d := d, k := k)) AS best FROM (
            SELECT r, vec_id, v.x, k, list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))::BIGINT AS d FROM v, c{i} AS c) GROUP BY r)"""
        )
        if i < rounds:
            steps.append(
                f"""c{i + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.x, c.x) AS x FROM c{i} AS c LEFT JOIN (SELECT k, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS x FROM (
                SELECT best.k AS k, i, sum(x[i]) AS s, count(*) AS n FROM a{i}, range(1, 65) AS t(i) GROUP BY best.k, i) GROUP BY k) AS m ON m.k = c.k)"""
            )
    return f"""WITH {", ".join(steps)}
        SELECT vec_id, best.k::INTEGER AS cluster, best.d AS distance, (sum(best.d) OVER (PARTITION BY best.k))::BIGINT AS cluster_inertia, (sum(best.d) OVER ())::BIGINT AS inertia,
               sha256(list_aggregate(c.x, 'string_agg', ',')) AS centroid_sha256
        FROM a{rounds} AS a JOIN c{rounds} AS c ON c.k = a.best.k"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_ann": op2_ann,
    "op3_mixing": op3_mixing,
    "op4_toxicity": op4_toxicity,
    "op5_bpe": op5_bpe,
    "op6_simhash": op6_simhash,
    "op7_chat": op7_chat,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_language_model": op9_language_model,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_whitening": op11_whitening,
    "op12_jaccard_join": op12_jaccard_join,
    "op13_centroids": op13_centroids,
}

SQL: dict[str, str] = {
    "op1_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
        d AS (SELECT page_id, h, max(page_id) OVER (PARTITION BY h) AS first, list_transform(range(8), lambda i: ('0x' || substr(x, 1 + 5 * i, 5))::BIGINT) AS v FROM p)
        SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes,
               list_aggregate(list_transform(flatten(list_transform(v, lambda n: [n // 32768, n // 1024 % 32, n // 32 % 32, n % 32])),
                              lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + k::INT, 1)), 'string_agg', '') AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to
        FROM d""",
    "op10_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op12_jaccard_join": r"""
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(w) BETWEEN 1 AND 3 THEN [array_to_string(w, ' ')]
                                  ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')))) END AS s FROM w),
        k AS MATERIALIZED (SELECT doc_id, s, len(s)::BIGINT AS n, md5(array_to_string(s, chr(10))) AS node FROM s),
        nodes AS MATERIALIZED (SELECT node, any_value(s) AS s, any_value(n) AS n, min(doc_id) AS first_id FROM k WHERE n > 0 GROUP BY node),
        t AS MATERIALIZED (SELECT token, node, n FROM (SELECT unnest(s) AS token, node, n FROM nodes) QUALIFY count(*) OVER (PARTITION BY token) > 1),
        links AS MATERIALIZED (SELECT a.node AS a, b.node AS b FROM t AS a JOIN t AS b ON a.token = b.token AND a.node <> b.node
                               GROUP BY a.node, b.node HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
        reach AS (SELECT node AS a, node AS b FROM nodes UNION SELECT r.a, l.b FROM reach AS r JOIN links AS l ON l.a = r.b),
        found AS (SELECT a AS node, min(first_id) AS component_id FROM reach JOIN nodes ON nodes.node = reach.b GROUP BY a)
        SELECT doc_id, k.n AS n_shingles, coalesce(component_id, doc_id) AS component_id FROM k LEFT JOIN found ON k.n > 0 AND found.node = k.node""",
    "op13_centroids": rounds_of_centroids(),
}
