"""Readers and writers of document collections and bibliographies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REGULATION = "country_code string, country_name string, url string, scraped_date string, num_sections int, sections array<struct<title:string,heading:string,main_content:string>>, _corrupt_record string"
DOCUMENT = ["doc_id", "source_type", "title", "text", "metadata"]


def read_regulations(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Documents from JSON files of one country each, or with one a line; unreadable ones are left out.

    Sections are joined under their titles, with their headings where these
    differ, and parted by rules.
    """
    raw = spark.read.schema(REGULATION).option("multiLine", not lines).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)

    def section(x: Column) -> Column:
        heading = F.when(F.coalesce(x["heading"], F.lit("")).isin("") | (x["heading"] == x["title"]), F.lit("")).otherwise(F.concat(F.lit("## "), x["heading"], F.lit("\n")))
        return F.concat(F.lit("# "), x["title"], F.lit("\n"), heading, F.lit("\n"), F.coalesce(x["main_content"], F.lit("")), F.lit("\n"), F.lit("\n---\n\n"))

    text = F.array_join(F.transform("sections", section), "")
    metadata = F.map_filter(F.create_map(F.lit("country_code"), F.col("country_code"), F.lit("country_name"), F.col("country_name"), F.lit("url"), F.col("url"), F.lit("scraped_date"), F.col("scraped_date"), F.lit("num_sections"), F.col("num_sections").cast("string")), lambda k, v: v.isNotNull())
    good = raw.where(F.col("country_code").isNotNull() & F.col("sections").isNotNull())
    return good.select(F.concat(F.lit("reg_"), "country_code").alias("doc_id"), F.lit("regulation").alias("source_type"), F.concat(F.lit("AI Regulations - "), "country_name").alias("title"), text.alias("text"), metadata.alias("metadata"))


def read_papers(texts: DataFrame, mapping: DataFrame, bibliography: DataFrame) -> DataFrame:
    """Documents from extracted texts (paper_id, text), their mapping (paper_id, doi, title, authors, year, journal) and a bibliography.

    Papers without mapping or DOI are left out; empty fields of the mapping are
    taken from the bibliography's row of the DOI (the last one, if several).
    """
    biblio = bibliography.withColumn("_order", F.monotonically_increasing_id()).groupBy(F.col("DOI").alias("doi")).agg(F.max_by(F.struct("Title", "Authors", "Year", "Source title"), "_order").alias("b"))
    joined = texts.join(mapping, "paper_id").where(F.coalesce("doi", F.lit("")) != "").join(biblio, "doi", "left")
    pick = lambda own, other, default: F.coalesce(F.nullif(F.col(own).cast("string"), F.lit("")), F.nullif(F.col(f"b.`{other}`").cast("string"), F.lit("")), F.lit(default))
    title = pick("title", "Title", "Untitled Paper")
    metadata = F.create_map(F.lit("doi"), F.col("doi"), F.lit("title"), title, F.lit("authors"), pick("authors", "Authors", "Unknown"), F.lit("year"), pick("year", "Year", "Unknown"), F.lit("journal"), pick("journal", "Source title", ""))
    return joined.select(F.col("paper_id").alias("doc_id"), F.lit("academic_paper").alias("source_type"), title.alias("title"), "text", metadata.alias("metadata"))


def read_paper_texts(spark: SparkSession, path: str) -> DataFrame:
    """(paper_id, text) of ``full.md`` files in folders named ``paper_*``."""
    files = spark.read.text(f"{path}/paper_*/full.md", wholetext=True).withColumn("file", F.col("_metadata.file_path"))
    return files.select(F.regexp_extract("file", r"/(paper_[^/]+)/full\.md$", 1).alias("paper_id"), F.col("value").alias("text"))


def read_bibliography(spark: SparkSession, path: str) -> DataFrame:
    """A bibliographic CSV file with quoted multi-value cells; a byte order mark in its head is dropped."""
    rows = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    return rows.toDF(*(c.lstrip("﻿") for c in rows.columns))


def parse_references(rows: DataFrame, key: str, references: str) -> DataFrame:
    """(key, place, author, title, journal, year, raw) of a cell of references parted by semicolons, fields by position."""
    one = rows.select(key, F.posexplode(F.filter(F.transform(F.split(references, ";"), lambda r: F.trim(r)), lambda r: r != "")).alias("place", "raw"))
    parts = F.filter(F.transform(F.split("raw", ","), lambda p: F.trim(p)), lambda p: (p != "") & ~p.rlike(r"^\(?\d{4}\)?$"))
    at = lambda i: F.coalesce(F.get(F.col("parts"), F.lit(i)), F.lit(""))
    author = F.when(F.size("parts") >= 2, F.concat(at(0), F.lit(", "), at(1))).otherwise(at(0))
    year = F.regexp_extract("raw", r"(?<!\d)((?:19|20)\d{2})(?!\d)", 1)
    return one.withColumn("parts", parts).select(key, "place", author.alias("author"), at(2).alias("title"), at(3).alias("journal"), F.when(year != "", year.cast("int")).alias("year"), "raw")


def bibliography_nodes(rows: DataFrame) -> dict[str, DataFrame]:
    """Publications, authors and journals of a bibliography with their ids; authors' names lose the id in brackets."""
    from tesselar.functions import ids

    pubs = rows.where(F.col("EID").isNotNull()).select(ids.publication_id(F.col("EID")).alias("publication_id"), F.col("EID").alias("source_id"), F.col("Title").alias("title"), F.col("Year").cast("int").alias("year"), F.col("DOI").alias("doi"))
    split = lambda c: F.transform(F.split(F.col(f"`{c}`"), ";"), lambda x: F.trim(x))
    zipped = F.arrays_zip(split("Author(s) ID").alias("id"), split("Author full names").alias("name"))
    people = rows.select(F.explode(zipped).alias("a")).select(F.col("a.id").alias("sid"), F.col("a.name").alias("full")).where(F.coalesce("sid", F.lit("")) != "")
    name = F.coalesce(F.nullif(F.trim(F.regexp_replace("full", r"\s*\(\d+\)\s*$", "")), F.lit("")), F.concat(F.lit("Author "), "sid"))
    authors = people.groupBy(ids.author_id(F.col("sid")).alias("author_id")).agg(F.min(name).alias("name"))
    journals = rows.where(F.coalesce(F.col("`Source title`"), F.lit("")) != "").groupBy(ids.journal_id(F.col("`Source title`")).alias("journal_id")).agg(F.min("`Source title`").alias("name"), F.min("ISSN").alias("issn"))
    return {"publications": pubs, "authors": authors, "journals": journals}


def read_lines(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON lines; blank lines are skipped."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(path)


def read_map(spark: SparkSession, path: str, value: str) -> DataFrame:
    """(key, value) of a JSON file that holds one object of objects."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string,{value}>")).alias("key", "value"))


def read_optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A parquet table, or an empty one if there is none."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.read.parquet(path)
    return spark.createDataFrame([], schema)


def write_split(rows: DataFrame, path: str, column: str) -> None:
    """One write, a folder for each value of a column: kept rows and those left out, by reason."""
    rows.write.mode("overwrite").partitionBy(column).parquet(path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Node and edge tables, by label and by relation; edges with a missing end are left out."""
    from tesselar.operators.graph import referential

    nodes.write.mode("overwrite").partitionBy("label").parquet(f"{path}/nodes")
    referential(edges, nodes).write.mode("overwrite").partitionBy("rel").parquet(f"{path}/edges")


def truncate_graph(spark: SparkSession, path: str) -> None:
    """Empty node and edge tables in place of what is there."""
    for part in ("nodes", "edges"):
        old = spark.read.parquet(f"{path}/{part}")
        spark.createDataFrame([], old.schema).write.mode("overwrite").parquet(f"{path}/{part}")


def read_preferred(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """The first table of ``paths`` that exists; an empty one if none does."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for path in paths:
        if hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop(path)):
            return spark.read.parquet(path)
    return spark.createDataFrame([], schema)


def write_csv(rows: DataFrame, path: str, append: bool = False) -> None:
    """CSV with a header, quotes doubled; new rows are added with ``append``."""
    rows.write.mode("append" if append else "overwrite").option("header", True).option("escape", '"').csv(path)
