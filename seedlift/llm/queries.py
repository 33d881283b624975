"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seedlift.llm import (
    bpe, centroids, contamination, ctw, language, neardup, packing, passages, quality, sharding, topk, toxicity, vector_codes)

QUERIES = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_bpe")
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = bpe.read_tokenizer(spark, public_tokenizers.path("word_bpe_49k.json"))
    return bpe.encode(table(spark, sf_dir, "documents"), tokenizer, with_ids=False)


@query("op2_topk", """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 10
""")
def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(topk.quantised(table(spark, sf_dir, "embeddings")), F.col("id") % 100 == 0)


@query("op3_quality")
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").filter(~toxicity.held_out())
    return quality.judge(table(spark, sf_dir, "documents"), labels)


@query("op4_minhash")
def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "keep")


@query("op5_substrings")
def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated(table(spark, sf_dir, "documents"))


@query("op6_toxicity")
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), toxicity.held_out()
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").filter(~held))
    return toxicity.score(docs, model).select(
        "doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))


@query("op7_sharding", """
WITH RECURSIVE steps(i, k, v) AS (
    SELECT range, 0, range FROM range(256)
    UNION ALL
    SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM steps WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS t FROM steps WHERE k = 8),
raw AS (
    SELECT doc_id, flatten(list_transform(string_split(coalesce(text, ''), ''), lambda c: CASE
        WHEN ord(c) <= 0 THEN []
        WHEN ord(c) < 128 THEN [ord(c)]
        WHEN ord(c) < 2048 THEN [192 + (ord(c) >> 6), 128 + (ord(c) & 63)]
        WHEN ord(c) < 65536 THEN [224 + (ord(c) >> 12), 128 + ((ord(c) >> 6) & 63), 128 + (ord(c) & 63)]
        ELSE [240 + (ord(c) >> 18), 128 + ((ord(c) >> 12) & 63), 128 + ((ord(c) >> 6) & 63), 128 + (ord(c) & 63)] END)) AS b,
        strlen(coalesce(text, '')) + 1 AS size
    FROM documents),
sized AS (
    SELECT doc_id, size, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), CAST(b AS BIGINT[])),
        lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32
    FROM raw, crc),
ordered AS (
    SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING) AS upto,
           sum(size) OVER () AS total, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) AS place
    FROM sized),
placed AS (SELECT *, CAST((2 * upto - size) * 8 // (2 * total) AS INTEGER) AS shard FROM ordered)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'bytes' AS law, shard,
       place - min(place) OVER (PARTITION BY shard) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM placed
""")
def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.byte_shards(table(spark, sf_dir, "documents"), 8)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


@query("op8_lm_scoring")
def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(toxicity.held_out(remainder=1), F.lit(False))
    scored = ctw.scores(table(spark, sf_dir, "documents"), ~held)
    return scored.select(
        "doc_id", (~F.col("trains")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score",
        (-F.col("score") / F.log10(F.lit(2.0)) / F.col("n_bytes")).alias("bits_per_byte"))


@query("op9_packing")
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids are the UTF-8 bytes of the texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("ids"))
    return packing.pack(docs).select(
        "pack_id", "n_ids", F.sha2("ids", 256).alias("ids_sha256"), "cu_seqlens", "resets", "doc_ids", "starts")


@query("op10_decontamination", r"""
WITH docs AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents),
items AS (
    SELECT item_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark),
starts AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, list_slice(w, s, least(s + 12, len(w))) AS t FROM starts),
phrases AS (SELECT DISTINCT item_id, len(t) AS n, array_to_string(t, ' ') AS phrase FROM windows),
lengths AS (SELECT DISTINCT n FROM phrases),
places AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM docs, lengths WHERE len(w) >= n),
found AS (
    SELECT p.doc_id, p.s, p.n, f.item_id
    FROM (SELECT doc_id, s, n, array_to_string(list_slice(w, s, s + n - 1), ' ') AS phrase FROM places) p
    JOIN phrases f ON f.n = p.n AND f.phrase = p.phrase),
hits AS (
    SELECT doc_id, count(DISTINCT pos) AS n_hit
    FROM (SELECT doc_id, unnest(range(s, s + n)) AS pos FROM found) GROUP BY doc_id),
named AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(n.items, '')) AS items_sha256,
       coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.w) AS contaminated
FROM docs d LEFT JOIN hits h ON h.doc_id = d.doc_id LEFT JOIN named n ON n.doc_id = d.doc_id
""")
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# ---- vectors ----------------------------------------------------------------------

def _kept_sql(scale: int, only: str = "") -> str:
    """CTE `kept`: vectors of whole numbers as doubles, whose sums and products are exact."""
    return f"""kept AS (
    SELECT *, row_number() OVER () AS r,
           list_transform(embedding, lambda x: floor({scale} * CAST(x AS DOUBLE))) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0{only})"""


def _rounds_sql(entries: int, rounds: int) -> str:
    """CTEs `near_0`, `book_1`, ... `near_<rounds>` from `parts` (r, p, part) and `book_0` (p, e, part)."""
    near = """near_{i} AS (
    SELECT r, p, CAST(min((list_dot_product(a.part, a.part) - 2 * list_dot_product(a.part, b.part)
        + list_dot_product(b.part, b.part)) * {n} + e) AS BIGINT) AS best
    FROM parts a JOIN book_{i} b USING (p) GROUP BY r, p)"""
    book = """means_{i} AS (
    SELECT p, best % {n} AS e, i, floor(sum(x) / count(*)) AS x
    FROM near_{i} JOIN places USING (r, p) GROUP BY p, best % {n}, i),
book_{j} AS (
    SELECT b.p, b.e, coalesce(m.part, b.part) AS part
    FROM book_{i} b LEFT JOIN (SELECT p, e, list(x ORDER BY i) AS part FROM means_{i} GROUP BY p, e) m USING (p, e))"""
    steps = ["places AS (SELECT r, p, unnest(part) AS x, generate_subscripts(part, 1) AS i FROM parts)", near.format(i=0, n=entries)]
    for i in range(rounds):
        steps += [book.format(i=i, j=i + 1, n=entries), near.format(i=i + 1, n=entries)]
    return ",\n".join(steps)


_NUMBERS = "list_transform(part, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR))"


@query("op11_vector_codes", f"""
WITH {_kept_sql(256)},
parts AS (
    SELECT r, p, list_slice(v, p * (len(v) // 16) + 1, (p + 1) * (len(v) // 16)) AS part
    FROM kept, (SELECT unnest(range(16)) AS p)),
book_0 AS (
    SELECT p, e, part
    FROM (SELECT r, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS e FROM kept) JOIN parts USING (r) WHERE e < 64),
{_rounds_sql(64, 2)},
coded AS (
    SELECT r, string_agg(printf('%02x', best % 64), '' ORDER BY p) AS code, CAST(sum(best // 64) AS BIGINT) AS error
    FROM near_2 GROUP BY r),
books AS (SELECT sha256(string_agg(array_to_string({_NUMBERS}, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book_2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM kept JOIN coded USING (r), books
""")
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One code of 16 parts for every vector of `embeddings`; see `vector_codes.compress`."""
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))[0].drop("label")


@query("op12_language")
def op12_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from three in four of them; see `language.fit` and `language.identify`."""
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    return language.identify(docs, language.fit(docs.filter(~held)), held_out=held)


@query("op13_centroids", f"""
WITH {_kept_sql(64, " AND len(embedding) = 64")},
parts AS (SELECT r, 0 AS p, v AS part FROM kept),
book_0 AS (
    SELECT p, e, part
    FROM (SELECT r, row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR)) NULLS LAST, v) - 1 AS e FROM kept)
    JOIN parts USING (r) WHERE e < 16),
{_rounds_sql(16, 3)},
found AS (SELECT r, best % 16 AS e, best // 16 AS distance FROM near_3)
SELECT vec_id, CAST(e AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY e) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string({_NUMBERS}, ',')) AS centroid_sha256
FROM kept JOIN found USING (r) JOIN book_3 USING (e)
""")
def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen clusters of the vectors of `embeddings`; see `centroids.cluster`."""
    return centroids.cluster(table(spark, sf_dir, "embeddings"))[0]
