"""The queries that apply the operators to whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import documents, table

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(documents(spark, sf_dir), tokenizer_path(), 1024)


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    return near_duplicates(documents(spark, sf_dir), width=2, threshold=0.8)


def op2_entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_documents

    return mix_documents(documents(spark, sf_dir), weights=(5, 2, 1), cap=3)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import remove_repeats

    return remove_repeats(documents(spark, sf_dir), width=13).withColumnRenamed("kept", "kept_sha256")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity as tox

    docs = documents(spark, sf_dir)
    model = tox.train(tox.learn(docs, table(spark, sf_dir, "labels"), "toxic"))
    scored = tox.score(docs, model)
    return scored.select(
        "doc_id", F.coalesce(tox.held_out_part(3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


def op3_edit_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import stored
    from .editsketch import fingerprint_and_edit, near_groups

    return near_groups(stored(fingerprint_and_edit(documents(spark, sf_dir)), "zstd"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality
    from .toxicity import held_out_part, learn

    docs = documents(spark, sf_dir)
    model = quality.train(learn(docs, table(spark, sf_dir, "labels"), "quality", max_docs=5000))
    return quality.score(docs, model).select(
        "doc_id", F.coalesce(held_out_part(3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract

    return extract(table(spark, sf_dir, "pages"))


def op7_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hamming import search, sign_codes

    codes = sign_codes(table(spark, sf_dir, "embeddings"))
    queries = codes.where("id % 20 = 0").select(F.col("id").alias("query_id"), "code")
    return search(codes, queries, k=10).withColumnRenamed("id", "vec_id")


def op8_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import kneser_ney as lm
    from .toxicity import held_out_part

    docs = documents(spark, sf_dir)
    held = F.coalesce(held_out_part(5) == 1, F.lit(False))
    model = lm.train(docs.where(~held)) or lm.EMPTY
    scored = lm.score(docs, model)
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


QUERIES = {
    f.__name__: f
    for f in (
        op1_best_fit_packing,
        op2_entropy_mixing,
        op3_edit_fingerprint,
        op4_minhash_near_dedup,
        op5_quality,
        op6_html_extraction,
        op7_hamming_topk,
        op8_kneser_ney,
        op9_substring_dedup,
        op10_toxicity,
    )
}

_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op4_minhash_near_dedup": f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWERED)} AS ws FROM documents),
 s AS (SELECT doc_id, CASE WHEN len(ws) > 1 THEN list_distinct([ws[i] || ' ' || ws[i + 1] for i in range(1, len(ws))]) ELSE ws END AS sh FROM w),
 e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS one FROM s),
 links AS (SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.one = b.one AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
 twoway AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
 reach(node, other) AS (SELECT x, y FROM twoway UNION SELECT node, y FROM reach JOIN twoway ON other = x),
 low AS (SELECT node, min(other) AS low FROM reach GROUP BY node)
 SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id, least(doc_id, coalesce(low, doc_id)) = doc_id AS kept FROM s LEFT JOIN low ON doc_id = node""",
    "op7_hamming_topk": """SELECT query_id, CAST(nth AS INTEGER) AS rank, vec_id, CAST(distance AS INTEGER) AS distance FROM
 (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS nth FROM
 (SELECT q.vec_id AS query_id, e.vec_id, list_sum([CAST((e.embedding[i] > 0) <> (q.embedding[i] > 0) AS INTEGER) for i in range(1, len(e.embedding) + 1)]) AS distance
 FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0)) WHERE nth <= 10""",
    "op9_substring_dedup": f"""WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
 win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
 first AS (SELECT k, min(doc_id) AS low FROM win GROUP BY k),
 gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN first USING (k) WHERE low < doc_id),
 placed AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS p FROM w),
 left_over AS (SELECT doc_id, string_agg(ws[p], ' ' ORDER BY p) AS kept FROM placed ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
 lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
 SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
 FROM w LEFT JOIN lost ON w.doc_id = lost.doc_id LEFT JOIN left_over ON w.doc_id = left_over.doc_id""",
}
