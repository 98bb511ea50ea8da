"""The queries of the ten training-data problems, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselar.llm import p01_language, p02_near, p03_split, p04_similar, p05_markup, p06_names, p07_garbled, p08_tokens, p09_leaks, p10_quality
from tesselar.session import table
from tesselar.storage import written


def p4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p04_similar.most_similar(table(spark, sf_dir, "embedded_chunks"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p04_similar.close_pairs(p04_similar.most_similar(table(spark, sf_dir, "embedded_chunks"), min_cosine=0.9), 0.9)


def p5_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p05_markup.clean_markup(table(spark, sf_dir, "raw_documents"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p05_markup.markup_found(p5_clean(spark, sf_dir))


def p6_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every spelling of people and organisations in entities and pre_entities."""
    entities, found = table(spark, sf_dir, "entities"), table(spark, sf_dir, "pre_entities")
    people, bodies = p06_names.PERSON, p06_names.ORGANISATION
    mentioned = found.where(F.col("type").isin(people + bodies) & F.col("name").isNotNull() & (F.trim("name") != ""))
    rows = p06_names.spellings(entities).select("is_person", "spelling").unionByName(mentioned.select(F.col("type").isin(people).alias("is_person"), F.col("name").alias("spelling"))).distinct()
    return p06_names.linked_names(rows, None)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p06_names.same_bearer(table(spark, sf_dir, "entities"))


def p7_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = [table(spark, sf_dir, t).select("doc_id", "text", F.lit(t).alias("source_table")) for t in ("raw_documents", "cleaned_documents")]
    both = texts[0].unionByName(texts[1])
    return p07_garbled.affected(both, p07_garbled.word_counts(both))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_restored(spark, sf_dir).select("doc_id").distinct()


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p08_tokens.encode_texts(table(spark, sf_dir, "documents"))


def p1_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p01_language.document_languages(table(spark, sf_dir, "cleaned_documents"))


def p1_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p01_language.paragraph_languages(table(spark, sf_dir, "cleaned_documents")).dropDuplicates(["doc_id", "paragraph"])


def p1_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p01_language.segment_languages(table(spark, sf_dir, "cleaned_documents"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p01_language.unclaimed(table(spark, sf_dir, "cleaned_documents"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p02_near.expand(p02_near.near_pairs(table(spark, sf_dir, "chunks")))


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p02_near.groups(p02_near.near_pairs(table(spark, sf_dir, "chunks")))


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p03_split.split_oversized(table(spark, sf_dir, "chunks"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_pieces(spark, sf_dir).select("chunk_id").distinct()


def p9_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p09_leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_leaks(spark, sf_dir).select("doc_id", "item_id").distinct()


def p10_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p10_quality.document_statistics(table(spark, sf_dir, "documents"))


def p10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p10_quality.outlier_scores(written(p10_statistics(spark, sf_dir), "statistics"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p10_quality.not_prose(table(spark, sf_dir, "documents"), table(spark, sf_dir, "quality_labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1:2].isdigit() and callable(f)}


_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
_SQL = {
    "p2_found": f"""WITH c AS (SELECT DISTINCT chunk_id, {_WORDS} AS w FROM chunks WHERE text IS NOT NULL), b AS (SELECT chunk_id, w FROM c WHERE len(w) >= 30),
 s AS (SELECT DISTINCT chunk_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM b), n AS (SELECT chunk_id, count(*) AS n FROM s GROUP BY chunk_id),
 p AS (SELECT x.chunk_id AS a, y.chunk_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.chunk_id < y.chunk_id GROUP BY 1, 2)
 SELECT a AS chunk_id_a, b AS chunk_id_b FROM p JOIN n u ON u.chunk_id = a JOIN n v ON v.chunk_id = b WHERE k >= 0.6 * (u.n + v.n - k)""",
    "p3_found": r"SELECT DISTINCT chunk_id FROM chunks WHERE len(regexp_extract_all(text, '\S+')) > 400",
    "p9_found": f"""WITH i AS (SELECT item_id, {_WORDS} AS w FROM eval_items), ig AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 11), lambda k: array_to_string(w[k:k + 12], ' '))) AS g FROM i WHERE len(w) >= 13),
 d AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL), dg AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 11), lambda k: array_to_string(w[k:k + 12], ' '))) AS g FROM d WHERE len(w) >= 13) SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)""",
}


def oracle_sql() -> dict[str, str]:
    """Where SQL can do the whole table: exact similarity, token counts and shared windows."""
    return dict(_SQL)
