"""Citations: who discusses what, and which reference of the citing document an entity means.

An entity is matched only against the references of the document its first chunk
comes from, so pairs meet in a join on that document. Three tiers, the first that
knows a reference wins: by type (an author against authors, a journal against
journals, a citation against titles), against any field, and by surname and year.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesselar.functions import fuzzy
from tesselar.functions import text as X
from tesselar.functions import values as V

CITED_TYPES = ["Citation", "Paper", "Article", "Publication", "Book"]


def capped(rows: DataFrame, by: list[str], order: list, most: int) -> DataFrame:
    """The first ``most`` rows of each group."""
    return rows.withColumn("_i", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_i") <= most).drop("_i")


def discusses(mentions: DataFrame, citations: int = 10, concepts: int = 15) -> DataFrame:
    """(chunk_id, subject, type, object): academic names and the concepts of the same chunk.

    Of a chunk the first ``citations`` names and ``concepts`` concepts in order take
    part, which bounds the pairs; this limit is the operator's own. A stand-in for a model that reads the chunk.
    """
    one = mentions.where(F.col("type").isin(V.ACADEMIC_TYPES)).select("chunk_id", F.col("name").alias("subject"), "type").distinct()
    two = mentions.where(F.col("type").isin(V.CONCEPT_TYPES)).select("chunk_id", F.col("name").alias("object")).distinct()
    return capped(one, ["chunk_id"], ["subject", "type"], citations).join(capped(two, ["chunk_id"], ["object"], concepts), "chunk_id")


def identify(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(entity_id, name, type, objects): entities of academic types that are the subject of ``discusses``, with what they discuss."""
    what = relations.groupBy("subject").agg(F.array_sort(F.collect_set("object")).alias("objects"))
    return entities.where(F.col("type").isin(V.ACADEMIC_TYPES)).join(what, F.col("name") == F.col("subject")).select("entity_id", "name", "type", "objects")


def year_of(text: Column) -> Column:
    """The first year from 1900 to 2099 that stands alone."""
    return F.nullif(F.regexp_extract(text, r"(?:^|[^0-9A-Za-z_])((?:19|20)[0-9]{2})(?:$|[^0-9A-Za-z_])", 1), F.lit("")).cast("int")


def partial_confidence(name_year: Column, surname: Column, ref_year: Column, ref_author: Column) -> Column:
    """Third tier: year and surname .65, the surname at the author's start .60, the year alone .50; else null."""
    has_year, has_name = name_year.isNotNull(), F.coalesce(surname, F.lit("")) != ""
    inside = F.contains(F.lower(ref_author), F.lower(surname))
    both = has_year & has_name & (ref_year == name_year) & inside
    start = ~has_year & has_name & F.startswith(F.lower(ref_author), F.lower(surname))
    return F.when(both, 0.65).when(start, 0.60).when(has_year & ~has_name & (ref_year == name_year), 0.50)


def match_references(entities: DataFrame, references: DataFrame, type_author: float = 0.80, type_journal: float = 0.80, type_title: float = 0.75, any_field: float = 0.65) -> DataFrame:
    """(entity_id, place, confidence, method): the reference each entity means.

    ``entities`` has entity_id, name, type and document; ``references`` document,
    place, surname, year, title and journal. Ties go to the smaller place.
    """
    r = references.select("document", "place", "year", *(X.match_key(F.col(c)).alias(c) for c in ("surname", "title", "journal")))
    pairs = entities.select("entity_id", "name", "type", "document").join(r, "document").withColumn("n", X.match_key(F.col("name"))).withColumn("own", X.match_key(X.surname(F.col("name"))))
    author = fuzzy.partial_ratio(F.col("own"), F.col("surname"))
    lead = F.startswith(F.col("surname"), F.col("own")) & (F.col("own") != "")
    rated = pairs.select(
        "*", author.alias("s_author"), fuzzy.ratio(F.col("n"), F.col("journal")).alias("s_journal"), fuzzy.ratio(F.col("n"), F.col("title")).alias("s_title"),
        *(fuzzy.partial_ratio(F.col("n"), F.col(c)).alias(f"f_{c}") for c in ("surname", "title", "journal")),
    )
    kind = F.col("type")
    by_type = (
        F.when((kind == "Author") & (F.col("s_author") >= type_author - F.when(lead, 0.1).otherwise(0.0)), F.struct(F.least(F.lit(1.0), F.col("s_author") + F.when(lead, 0.1).otherwise(0.0)).alias("s"), F.lit("type_author").alias("m")))
        .when((kind == "Journal") & (F.col("s_journal") >= type_journal), F.struct(F.col("s_journal").alias("s"), F.lit("type_journal").alias("m")))
        .when(kind.isin(CITED_TYPES) & (F.col("s_title") >= type_title), F.struct(F.col("s_title").alias("s"), F.lit("type_title").alias("m")))
    )
    most = F.greatest("f_surname", "f_title", "f_journal")
    field = F.when(F.col("f_surname") == most, "fuzzy_author").when(F.col("f_title") == most, "fuzzy_title").otherwise("fuzzy_journal")
    fuzzy_tier = F.when(most >= any_field, F.struct(most.alias("s"), field.alias("m")))
    loose = partial_confidence(year_of(F.col("name")), F.col("own"), F.col("year"), F.col("surname"))
    partial = F.when(loose.isNotNull(), F.struct(loose.alias("s"), F.lit("partial").alias("m")))
    tiers = rated.select("entity_id", "place", F.explode(F.array(*(F.struct(F.lit(-i).alias("tier"), t["s"].alias("s"), t["m"].alias("m")) for i, t in enumerate((by_type, fuzzy_tier, partial))))).alias("t"))
    best = tiers.where(F.col("t.s").isNotNull()).groupBy("entity_id").agg(F.max(F.struct(F.col("t.tier"), F.col("t.s"), (-F.col("place")).alias("p"), F.col("t.m"))).alias("b"))
    return best.select("entity_id", (-F.col("b.p")).alias("place"), F.col("b.s").alias("confidence"), F.col("b.m").alias("method"))


def answers(chunks: DataFrame, ranked: DataFrame) -> DataFrame:
    """(query, answer): the first sentence of each chunk, in the order of rank, with the chunk's number as its citation. A stand-in for a model."""
    said = ranked.join(chunks, "chunk_id").select("query", "rank", F.concat(F.get(F.split("text", r"\. "), F.lit(0)), F.lit(" ["), F.col("rank").cast("string"), F.lit("]")).alias("line"))
    return said.groupBy("query").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), " ").alias("answer"))


def word_set(text: Column, least: int) -> Column:
    """The different words of at least ``least`` letters."""
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: F.length(w) >= least))


def best_chunks(queries: DataFrame, chunks: DataFrame, k: int = 3, least: int = 8) -> DataFrame:
    """(query, chunk_id, shared, rank): the k chunks that share most long words with each query. A stand-in for vectors."""
    q = queries.select("query", F.explode(word_set(F.col("text"), least)).alias("w"))
    t = chunks.select("chunk_id", F.explode(word_set(F.col("text"), least)).alias("w"))
    shared = t.join(q, "w").groupBy("query", "chunk_id").agg(F.count(F.lit(1)).alias("shared"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("shared"), "chunk_id"))
    return shared.withColumn("rank", rank).where(F.col("rank") <= k)
