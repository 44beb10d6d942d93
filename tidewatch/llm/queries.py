"""The registered queries of these operators, each over its whole table, and the SQL they are checked with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import chat, decontaminate, jaccard, language, licenses, lines, mixing, negatives, pii, quality, tokens, topk, whitening
from tidewatch.llm.store import kept, literal_table


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_token_shards(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.token_shards(table(spark, folder, "documents"), tokens.vocabulary_of(spark))


def op2_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, folder, "documents"))


def op3_pfair_mix(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mixed(table(spark, folder, "documents").select("doc_id", "text", "source"))
    return mixed.select("row.doc_id", "source", "block", "place", "slot", "release", "deadline")


def op4_chat_prefixes(spark: SparkSession, folder: str) -> DataFrame:
    hard = r"\### Assistant: </turn> ok"
    more = literal_table(spark, [{"conv_id": -7, "turn": turn, "role": role, "text": hard} for turn, role in enumerate(("user", "assistant"))],
                         "conv_id long; turn long; role string; text string")
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    written = kept(chat.formatted_turns(turns), "turns")
    return chat.digest(written, kept(chat.examples(written), "examples"))


def op5_near_lines(spark: SparkSession, folder: str) -> DataFrame:
    return lines.line_places(table(spark, folder, "documents"))


def op6_language_mixture(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = language.train(docs.where(~language.held_out()))
    found = language.predict(docs, model)
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score", "languages")


def op7_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    vectors = topk.whole_components(table(spark, folder, "embeddings"))
    return topk.top_k(vectors.where(F.col("vec_id") % 100 == 0), vectors)


def op8_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, folder, "documents"))


def op9_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return pii.digest(pii.find_personal_data(table(spark, folder, "documents")))


def op10_benchmark_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    vectors = negatives.labelled_vectors(table(spark, folder, "embeddings"))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(vectors.withColumn("label", moved), F.col("vec_id") % 100 == 0).drop("positive_rank")


def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings"))


def op13_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    found = quality.score(docs, quality.train(docs, labels.where(~quality.held_out())))
    return found.select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline          # the pipeline's own module, at the repository top

    return corpus_pipeline.run(spark, folder)


QUERIES = {q.__name__: q for q in (
    op1_token_shards, op2_license_scan, op3_pfair_mix, op4_chat_prefixes, op5_near_lines, op6_language_mixture,
    op7_exact_top_k, op8_jaccard_join, op9_personal_data, op10_benchmark_leaks,
    op11_hard_negatives, op12_whitening, op13_quality_classifier, pipeline)}

ORACLE = {
    "op4_chat_prefixes": r"""
        WITH hard AS (SELECT '\### Assistant: </turn> ok' AS t),
        rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                 UNION ALL SELECT -7, 0, 'user', t FROM hard UNION ALL SELECT -7, 1, 'assistant', t FROM hard),
        coded AS (SELECT *, length(role) + length(text)
                  + length(regexp_replace(role || text, '[^\\#<:]', '', 'g')) + length('### : </turn>') + 1 AS n FROM rows)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(n) AS BIGINT) AS formatted_chars
        FROM coded GROUP BY conv_id""",
    "op7_exact_top_k": """
        WITH good AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
                      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (SELECT q.vec_id AS query_id, c.vec_id,
                          CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
                   FROM good q JOIN good c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 10""",
    "op8_jaccard_join": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x20\x09-\x0D]+') AS w FROM documents),
        shingles AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                         ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS s FROM words),
        sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
        pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id
                  GROUP BY 1, 2),
        links AS (SELECT a, b FROM pairs JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
                  WHERE 100 * common >= 80 * (p.n + q.n - common)),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM sizes UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
        least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
        SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id
        FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN least ON a = d.doc_id""",
    "op11_hard_negatives": """
        WITH good AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                             list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
                      WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
                        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
                          CAST(list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
                   FROM good a JOIN good c ON c.vec_id <> a.vec_id WHERE a.vec_id % 100 = 0),
        near AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
                 QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
        hard AS (SELECT anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score,
                        row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
                 FROM near JOIN scored USING (anchor_id)
                 WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
        SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM hard WHERE rank <= 10""",
}
