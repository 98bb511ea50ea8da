"""Sources, chunking, model operators and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesselar.functions import models
from tesselar.operators import chunking
from tesselar.plans import graph_tables as T
from tesselar.plans.link_queries import REFS, refs
from tesselar.plans.registry import register
from tesselar.functions import values as V
from tesselar.plans.text_queries import _hints_sql, _lines, sections
from tesselar.session import bounded, table
from tesselar.sources import documents as D
from tesselar.sources import html as H
from tesselar.storage import place_for
from tesselar.streaming import events as S

c = F.col


def _place(s, name: str) -> str:
    return place_for(s, name)


@register(
    "scan_regulation_docs",
    "SELECT doc_id, 'AI Regulations - ' || doc_id[5:] AS title, '1' AS sections, md5('# Overview' || chr(10) || CASE WHEN coalesce(title, '') IN ('', 'Overview') THEN '' ELSE '## ' || title || chr(10) END || chr(10) || text || chr(10) || chr(10) || '---' || chr(10) || chr(10)) AS digest FROM raw_documents WHERE starts_with(doc_id, 'reg') AND text IS NOT NULL",
)
def scan_regulation_docs(s, d):
    """The regulations written as JSON objects and read back as documents."""
    place = _place(s, "regulations")
    code = F.regexp_extract("doc_id", r"^reg_(.*)$", 1)
    section = F.struct(F.lit("Overview").alias("title"), c("title").alias("heading"), c("text").alias("main_content"))
    rows = table(s, d, "raw_documents").where("doc_id LIKE 'reg%' AND text IS NOT NULL").select(code.alias("country_code"), code.alias("country_name"), c("metadata")["url"].alias("url"), c("fetched_at").cast("string").alias("scraped_date"), F.lit(1).alias("num_sections"), F.array(section).alias("sections"))
    rows.write.json(place)
    return D.read_regulations(s, place, lines=True).select("doc_id", "title", c("metadata")["num_sections"].alias("sections"), F.md5("text").alias("digest"))


PAPERS = r"p AS (SELECT DISTINCT doc_id, title, fetched_at, map_extract(metadata, 'year')[1] AS y, CAST(regexp_extract(doc_id, '([0-9]+)$', 1) AS BIGINT) AS n FROM raw_documents WHERE starts_with(doc_id, 'paper') AND text IS NOT NULL)"


@register("load_papers", f"WITH {PAPERS} SELECT doc_id, coalesce(nullif(title, ''), 'Untitled Paper') AS title, coalesce(nullif(y, ''), CAST(year(fetched_at) AS VARCHAR), 'Unknown') AS year, '10.1000/' || doc_id AS doi FROM p WHERE n % 10 > 0")
def load_papers(s, d):
    """Texts, mapping and bibliography of the papers joined; every tenth has no DOI and is left out, as the operator has it."""
    papers = table(s, d, "raw_documents").where("doc_id LIKE 'paper%' AND text IS NOT NULL").dropDuplicates(["doc_id"])
    texts = papers.select(c("doc_id").alias("paper_id"), "text")
    doi = F.when(F.regexp_extract("doc_id", "([0-9]+)$", 1).cast("bigint") % 10 > 0, F.concat(F.lit("10.1000/"), "doc_id"))
    mapping = papers.select(c("doc_id").alias("paper_id"), doi.alias("doi"), F.lit("").alias("title"), F.lit(None).cast("string").alias("authors"), c("metadata")["year"].alias("year"), F.lit("").alias("journal"))
    place = _place(s, "bibliography")
    papers.select(F.concat(F.lit("10.1000/"), "doc_id").alias("DOI"), F.coalesce("title", F.lit("")).alias("Title"), c("metadata")["source"].alias("Authors"), F.year("fetched_at").alias("Year"), c("metadata")["source"].alias("Source title")).write.option("header", True).option("escape", '"').csv(place)
    return D.read_papers(texts, mapping, D.read_bibliography(s, place)).select("doc_id", "title", c("metadata")["year"].alias("year"), c("metadata")["doi"].alias("doi"))


@register("scan_biblio_csv", f"WITH {REFS}, x AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY place, surname, title) - 1 AS i FROM refs) SELECT CAST(doc_id AS VARCHAR) AS EID, CAST(i AS INTEGER) AS place, surname || ', ' || initial || '.' AS author, title, journal, year, surname || ', ' || initial || '., ' || title || ', ' || journal || ', (' || year || ')' AS raw FROM x")
def scan_biblio_csv(s, d):
    """The references of each document written as one cell of a bibliographic CSV table, read back and taken apart."""
    place = _place(s, "biblio")
    one = F.concat("surname", F.lit(", "), "initial", F.lit("., "), "title", F.lit(", "), "journal", F.lit(", ("), c("year").cast("string"), F.lit(")"))
    cells = refs(s, d).groupBy(c("doc_id").alias("EID")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "surname", "title", one.alias("r")))), lambda x: x["r"]), "; ").alias("References"))
    cells.write.option("header", True).option("escape", '"').csv(place)
    return D.parse_references(D.read_bibliography(s, place), "EID", "References")


@register("html_sections")
def html_sections(s, d):
    docs = table(s, d, "raw_documents").where("text IS NOT NULL")
    page = F.concat(F.lit('<div class="page-nav-accordion__item"><a class="page-nav-accordion__title">'), F.coalesce("title", F.lit("Untitled")), F.lit('</a><div class="page-nav-accordion__content">'), "text", F.lit("</div></div>"))
    return H.html_sections(docs.select("doc_id", page.alias("html")), "doc_id", "html").select("doc_id", "section.title", "section.heading", "section.main_content", F.size("section.links").alias("links"))


@register("html_text")
def html_text(s, d):
    return H.html_text(table(s, d, "raw_documents").where("text IS NOT NULL"), "doc_id", "text")


@register("semantic_chunks_build")
def semantic_chunks_build(s, d):
    return chunking.chunk_sections(sections(_lines(s, d)), key="doc_id")


@register("chunk_documents")
def chunk_documents(s, d):
    from pyspark.sql import Window

    from tesselar.functions.text import garbage_header

    kept = sections(_lines(s, d)).where(c("header").isNull() | ~garbage_header(c("header")))
    rated = chunking.chunk_sections(kept, key="doc_id").withColumn("reason", chunking.quality_reason())
    good = F.row_number().over(Window.partitionBy("doc_id", c("reason").isNull()).orderBy("section", "part")) - 1
    return rated.withColumn("position", F.when(c("reason").isNull(), good)).select("doc_id", "section", "part", "position", "reason", "sentence_count", "token_count", F.round("coherence", 6).alias("coherence"))


@register("extract_entities")
def extract_entities(s, d):
    return models.extract_entities(table(s, d, "chunks"))


@register("judge_pairs")
def judge_pairs(s, d):
    e = table(s, d, "entities").where("name IS NOT NULL").select(c("name").alias("name_a"), F.explode("aliases").alias("name_b"))
    return models.judge_pairs(e)


@register("translation_cache", "SELECT doc_id, coalesce(lang IN ('fr', 'de'), false) AS was_translated FROM documents")
def translation_cache(s, d):
    docs = table(s, d, "documents")
    cache = docs.where("lang IN ('fr', 'de')").select("doc_id", c("lang").alias("language"), F.concat(F.lit("[en] "), F.coalesce("text", F.lit(""))).alias("translated"))
    return models.translate(docs, cache).select("doc_id", "was_translated")


@register("missing_vectors", "SELECT DISTINCT chunk_id FROM chunks WHERE chunk_id NOT IN (SELECT chunk_id FROM embedded_chunks WHERE embedding IS NOT NULL)")
def missing_vectors(s, d):
    have = table(s, d, "embedded_chunks").where("embedding IS NOT NULL").select("chunk_id").distinct()
    return models.missing_vectors(table(s, d, "chunks").select("chunk_id").distinct(), have, "chunk_id")


@register("sliding_rate", "SELECT event_id, count(*) OVER (ORDER BY epoch_us(ts) RANGE BETWEEN 60000000 PRECEDING AND CURRENT ROW) AS n FROM events")
def sliding_rate(s, d):
    """Events in the 60 seconds up to each event.

    Time is cut into minutes; an event needs its own minute's rows and those of
    the minute before, so minutes are partitions and no window runs over the whole table.
    """
    e = table(s, d, "events").select("event_id", F.unix_micros(c("ts").cast("timestamp")).alias("t"))
    minute = F.floor(c("t") / 60_000_000)
    both = e.select("event_id", "t", F.explode(F.array(minute, minute + 1)).alias("m"), minute.alias("own"))
    from pyspark.sql import Window

    w = Window.partitionBy("m").orderBy("t").rangeBetween(-60_000_000, 0)
    return both.withColumn("n", F.count(F.lit(1)).over(w)).where("m = own").select("event_id", "n")


def _epoch(column: str):
    return F.unix_timestamp(column)


@register("stream_tumbling", "SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(s, d):
    src = S.source(s, d, "events.parquet")
    return S.run_to_table(S.tumbling(src.stream), "tumbling", closing=src).withColumn("start", _epoch("start"))


@register("stream_sliding", "SELECT CAST(w AS BIGINT) AS start, count(*) AS n FROM (SELECT unnest(list_transform(range(0, 6), lambda k: (epoch_us(ts) // 10000000 - k) * 10)) AS w FROM events) GROUP BY 1")
def stream_sliding(s, d):
    src = S.source(s, d, "events.parquet")
    return S.run_to_table(S.sliding_rate(src.stream), "sliding", closing=src).withColumn("start", _epoch("start"))


@register(
    "stream_sessions",
    "WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w > INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o) SELECT user_id, epoch_us(min(ts)) AS start, epoch_us(max(ts)) + 1800000000 AS end, count(*) AS n FROM g GROUP BY user_id, k",
)
def stream_sessions(s, d):
    src = S.source(s, d, "events.parquet")
    return S.run_to_table(S.sessions(src.stream), "sessions", closing=src).withColumns({"start": F.unix_micros("start"), "end": F.unix_micros("end")})


@register("stream_dedup", "SELECT DISTINCT ON (event_id) event_id, epoch_us(ts) AS ts, user_id, event_type, value, props FROM events")
def stream_dedup(s, d):
    return S.run_to_table(S.deduplicated(S.read_stream(s, d, "events.parquet")), "dedup").withColumn("ts", F.unix_micros("ts"))


@register("event_json", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def event_json(s, d):
    return table(s, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@register("parse_query", f"SELECT i.item_id AS item_id, coalesce(list_sort(list(DISTINCT entity_id) FILTER (WHERE entity_id IS NOT NULL)), []) AS entities, {_hints_sql('any_value(i.text)', V.JURISDICTION_WORDS)} AS jurisdictions, {_hints_sql('lower(any_value(i.text))', V.DOCUMENT_WORDS)} AS kinds FROM eval_items i LEFT JOIN concepts ON contains(lower(i.text), lower(name)) GROUP BY i.item_id")
def parse_query(s, d):
    """Queries with their hints and the concepts and regulations that they name."""
    from tesselar.plans.text_queries import _hints

    items = table(s, d, "eval_items")
    # concepts are a fixed table of 140 names
    named = items.join(bounded(table(s, d, "concepts").select(F.lower("name").alias("k"), "entity_id")), F.contains(F.lower("text"), c("k")), "left")
    return named.groupBy("item_id", "text").agg(F.array_sort(F.collect_set("entity_id")).alias("entities")).select("item_id", "entities", _hints(c("text"), V.JURISDICTION_WORDS).alias("jurisdictions"), _hints(F.lower("text"), V.DOCUMENT_WORDS).alias("kinds"))


@register("graph_sink", T.GRAPH + "SELECT label AS kind, count(*) AS n FROM nodes GROUP BY 1 UNION ALL SELECT rel, count(*) FROM edges WHERE src IN (SELECT id FROM nodes) AND dst IN (SELECT id FROM nodes) GROUP BY 1")
def graph_sink(s, d):
    """The graph written by label and relation, and what was written counted."""
    place = _place(s, "graph")
    D.write_graph(T.nodes(s, d), T.edges(s, d), place)
    n = s.read.parquet(f"{place}/nodes").groupBy(c("label").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return n.unionByName(s.read.parquet(f"{place}/edges").groupBy(c("rel").alias("kind")).agg(F.count(F.lit(1)).alias("n")))


@register("embed_chunks")
def embed_chunks(s, d):
    """Vectors of chunks without one, by the offline model."""

    def encode(batches):
        import pandas as pd

        model = chunking.HashedWords(64)
        for pdf in batches:
            yield pd.DataFrame({"chunk_id": pdf.chunk_id, "embedding": [v.astype("f4").tolist() for v in model.encode(pdf.text.tolist())]})

    todo = models.missing_vectors(table(s, d, "chunks").where("text IS NOT NULL").select("chunk_id", "text"), table(s, d, "embedded_chunks").where("embedding IS NOT NULL"), "chunk_id")
    return todo.mapInPandas(encode, "chunk_id string, embedding array<float>")


SUPPORT = "list_distinct(list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda w: length(w) > 3))"


@register("support_scores", f"WITH x AS (SELECT doc_id, {SUPPORT.format('title')} AS a, {SUPPORT.format('text')} AS b FROM documents WHERE title IS NOT NULL AND text IS NOT NULL) SELECT doc_id, round(CASE WHEN len(a) > 0 THEN len(list_intersect(a, b))::DOUBLE / len(a) ELSE 0 END, 6) AS support FROM x")
def support_scores(s, d):
    words = lambda x: F.array_distinct(F.filter(F.split(F.lower(x), "[^a-z0-9]+"), lambda w: F.length(w) > 3))
    return table(s, d, "documents").where("title IS NOT NULL AND text IS NOT NULL").select("doc_id", F.round(models.support_score(words("title"), words("text")), 6).alias("support"))
