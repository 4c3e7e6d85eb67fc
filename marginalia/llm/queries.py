"""The registered queries ``opN_<name>`` and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import alignment, ann, bpe, hmm, jaccard, lexical, packing, pii, repetition, secrets, toxicity, urls, warc
from marginalia.llm.common import UPPER, fold

END_ID = 1

#: The rules of the url query.
URL_RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]
#: A host is on the list if one of these is a part of it between dots and hyphens.
HOST_WORDS = "ads adult bets betting casino farm loans pills poker porn sex spam viagra xxx".split()
HOST_PATTERN = r"(^|[.-])(" + "|".join(HOST_WORDS) + r")([.-]|$)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_hmm_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (fold(F.col("doc_id"), 7) == 2).alias("held_out"))
    return hmm.score(docs)


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    held_out = fold(F.col("doc_id"), 5) == 0
    model = toxicity.fit(toxicity.labelled(docs.filter(~held_out), labels.filter(~held_out)))
    return toxicity.score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", toxicity.predicted(F.col("score")).alias("predicted")
    )


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    s = F.col("spans")
    base = F.filter(s, lambda x: x["k"] < 3)
    return found.select(
        "doc_id",
        *(F.size(secrets.kind(s, k)).cast("long").alias(f"n_{secrets.KINDS[k]}") for k in range(3)),
        F.sha2(secrets.joined(base), 256).alias("base_sha256"),
        secrets.joined(s).alias("spans"),
    )


def op5_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary(), END_ID)


def op6_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return ann.search(vectors, F.col("vec_id") % 20 == 0)


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"), carry=False)
    s = F.col("spans")
    base = F.filter(s, lambda x: x["kind"] != "id")
    return found.select(
        "doc_id",
        *(F.size(pii.of_kind(s, k)).cast("long").alias(f"n_{k}") for k in pii.KINDS),
        F.sha2(pii.joined(base), 256).alias("base_sha256"),
        pii.joined(s).alias("spans"),
    )


def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary())


def listed_hosts(hosts: DataFrame) -> DataFrame:
    return hosts.filter(F.col("host").rlike(HOST_PATTERN)).select(F.col("host").alias("key"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(pages, URL_RULES, listed_hosts).select("page_id", "host", "path", "rule", "verdict")


def op10_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = repetition.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op11_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), vocabulary(), piece_model())


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_hmm_language_model,
        op2_ngram_jaccard_join,
        op3_toxicity,
        op4_secret_scan,
        op5_vector_packing,
        op6_projection_forest,
        op7_personal_data,
        op8_bpe_round_trip,
        op9_url_filter,
        op10_repetition_rules,
        op11_warc_archive,
        op12_token_alignment,
        op13_lexical_search,
        pipeline,
    )
}

_RULES = ", ".join(f"('{v}', '{r}')" for v, r in URL_RULES)
SQL = {
    "op9_url_filter": rf"""
WITH rules(v, r) AS (VALUES {_RULES}),
parts AS (
  SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
),
named AS (
  SELECT page_id,
         translate(regexp_extract(rest, '\A[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '\A[^/?#]*([^?#]*)', 1) AS path
  FROM parts
),
judged AS (
  SELECT n.*, (
    SELECT max_by(struct_pack(v := v, r := r), length(r)) FROM rules
    WHERE (n.host = split_part(r, '/', 1) OR ends_with(n.host, '.' || split_part(r, '/', 1)))
      AND starts_with(n.path, substr(r, strpos(r, '/')))
  ) AS hit
  FROM named n
)
SELECT page_id, host, path, hit.r AS rule,
       CASE WHEN hit IS NOT NULL THEN hit.v
            WHEN regexp_matches(host, '{HOST_PATTERN}') THEN 'block' ELSE 'allow' END AS verdict
FROM judged
""",
    "op11_warc_archive": """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes < 100 OR page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
""",
    "op13_lexical_search": rf"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '{lexical.TERM}')) AS term
  FROM documents
),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '{lexical.TERM}')) AS term
  FROM benchmark
),
sizes AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
total AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS big_l FROM sizes),
lengths AS (SELECT doc_id, 100 - 50 + ((50 * n * big_n) // big_l) AS m FROM sizes, total),
tf AS (SELECT doc_id, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, term),
weights AS (
  SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), total
),
scored AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM asked JOIN tf USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id) GROUP BY item_id, doc_id
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0
)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= 50
""",
}
