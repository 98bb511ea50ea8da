"""Bibliographic linkage and enrichment."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tesselar.functions import ids
from tesselar.functions import text as X
from tesselar.operators import linkage as L
from tesselar.operators import resolve as E
from tesselar.plans.registry import register
from tesselar.plans.text_queries import q
from tesselar.session import table
from tesselar.storage import written

c = F.col
P = lambda i: f"regexp_extract(raw, {q(L.REFERENCE)}, {i})"
REFS = f"l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw FROM documents WHERE text IS NOT NULL), refs AS (SELECT doc_id, CAST({P(1)} AS INTEGER) AS place, {P(2)} AS surname, {P(3)} AS initial, CAST({P(4)} AS INTEGER) AS year, {P(5)} AS title, {P(6)} AS journal FROM l WHERE regexp_matches(raw, {q(L.REFERENCE)}))"


def refs(s, d):
    return L.references(table(s, d, "documents"))


@register("parse_reference", f"WITH {REFS} SELECT doc_id, place, surname, initial, year, title, journal FROM refs")
def parse_reference(s, d):
    return refs(s, d)


FREE = r"l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw FROM documents WHERE text IS NOT NULL), f AS (SELECT doc_id, raw, regexp_replace(raw, '^\[\d+\]\s*', '') AS bare FROM l WHERE regexp_matches(raw, '\(?(19|20)\d{2}\)?') AND regexp_matches(raw, '^(\[\d+\]\s*)?[A-Z]')), g AS (SELECT doc_id, regexp_extract(bare, '^([^(]{2,80}?)\s*\(', 1) AS a, CAST(regexp_extract(raw, '\(?((?:19|20)\d{2})\)?', 1) AS INTEGER) AS year, regexp_extract(bare, '\((?:19|20)\d{2}\)\.?\s*([^.]+)\.', 1) AS title FROM f)"


@register("parse_ref_free", f"WITH {FREE} SELECT doc_id, CASE WHEN contains(a, ',') THEN trim(string_split(a, ',')[1]) ELSE regexp_split_to_array(trim(a), ' +')[-1] END AS surname, year, title FROM g WHERE title <> ''")
def parse_ref_free(s, d):
    """References in any form: year, first author and title by position."""
    lines = table(s, d, "documents").where("text IS NOT NULL").select("doc_id", F.explode(F.split("text", "\n")).alias("raw")).where(c("raw").rlike(r"\(?(19|20)\d{2}\)?") & c("raw").rlike(r"^(\[\d+\]\s*)?[A-Z]"))
    bare = F.regexp_replace("raw", r"^\[\d+\]\s*", "")
    year = F.regexp_extract("raw", r"\(?((?:19|20)\d{2})\)?", 1)
    title = F.regexp_extract(bare, r"\((?:19|20)\d{2}\)\.?\s*([^.]+)\.", 1)
    return lines.select("doc_id", X.surname(F.regexp_extract(bare, r"^([^(]{2,80}?)\s*\(", 1)).alias("surname"), year.cast("int").alias("year"), title.alias("title")).where("title <> ''")


@register("biblio_nodes", f"WITH {REFS} SELECT DISTINCT 'pub_l2_' || substring(sha256(trim(lower(surname || ' ' || year || ' ' || title))), 1, 12) AS id, 'L2Publication' AS label, title AS name FROM refs UNION ALL SELECT DISTINCT 'journal_' || substring(sha256(trim(lower(journal))), 1, 12), 'Journal', journal FROM refs UNION ALL SELECT DISTINCT 'author_' || surname || '_' || initial, 'Author', surname || ', ' || initial || '.' FROM refs")
def biblio_nodes(s, d):
    r = refs(s, d)
    pub = r.select(_pub().alias("id"), F.lit("L2Publication").alias("label"), c("title").alias("name")).distinct()
    jou = r.select(ids.journal_id(c("journal")).alias("id"), F.lit("Journal").alias("label"), c("journal").alias("name")).distinct()
    aut = r.select(_aut().alias("id"), F.lit("Author").alias("label"), F.concat("surname", F.lit(", "), "initial", F.lit(".")).alias("name")).distinct()
    return pub.unionByName(jou).unionByName(aut)


def _pub():
    return ids.publication_id(F.concat("surname", F.lit(" "), c("year").cast("string"), F.lit(" "), "title"), 2)


def _aut():
    return F.concat(F.lit("author_"), "surname", F.lit("_"), "initial")


@register("authored_by", f"WITH {REFS} SELECT DISTINCT 'pub_l2_' || substring(sha256(trim(lower(surname || ' ' || year || ' ' || title))), 1, 12) AS src, 'author_' || surname || '_' || initial AS dst FROM refs")
def authored_by(s, d):
    return refs(s, d).select(_pub().alias("src"), _aut().alias("dst")).distinct()


@register("l2_exact_dedup", f"WITH {REFS} SELECT lower(surname) AS author, year, trim(regexp_replace(regexp_replace(lower(title), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g')) AS title, count(*) AS n, min(doc_id) AS first_doc FROM refs GROUP BY 1, 2, 3")
def l2_exact_dedup(s, d):
    return refs(s, d).groupBy(F.lower("surname").alias("author"), "year", X.match_key(c("title")).alias("title")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))


@register("l2_fuzzy_dedup")
def l2_fuzzy_dedup(s, d):
    return L.dedupe_works(refs(s, d).withColumn("ref", _pub()))


AUTHORS = "a AS (SELECT entity_id, CASE WHEN contains(name, ',') THEN trim(string_split(name, ',')[1]) ELSE regexp_split_to_array(trim(name), ' +')[-1] END AS surname, CASE WHEN contains(name, ',') THEN upper(trim(string_split(name, ',')[2])[1:1]) WHEN len(regexp_split_to_array(trim(name), ' +')) > 1 THEN upper(trim(name)[1:1]) END AS initial FROM entities WHERE type = 'Author' AND name IS NOT NULL)"


def authors(s, d):
    return table(s, d, "entities").where("type = 'Author' AND name IS NOT NULL").select("entity_id", X.surname(c("name")).alias("surname"), X.initial(c("name")).alias("initial"))


@register("author_lookup", f"WITH {AUTHORS} SELECT x.entity_id AS entity_id, min(y.entity_id) AS other FROM a x JOIN a y ON lower(x.surname) = lower(y.surname) AND x.initial = y.initial AND x.entity_id <> y.entity_id GROUP BY 1")
def author_lookup(s, d):
    a = authors(s, d)
    b = a.select(c("entity_id").alias("o"), F.lower("surname").alias("k"), c("initial").alias("i"))
    return a.join(b, (F.lower("surname") == c("k")) & (c("initial") == c("i")) & (c("entity_id") != c("o"))).groupBy("entity_id").agg(F.min("o").alias("other"))


@register("match_author")
def match_author(s, d):
    """Authors against the authors mentioned in chunks: the most similar surname of the same initial, equal ones 1.0."""
    left = authors(s, d).where("initial IS NOT NULL").select(c("entity_id").alias("id"), c("surname").alias("title"), "initial")
    m = table(s, d, "pre_entities").where("type = 'Author' AND name IS NOT NULL")
    right = m.groupBy(X.surname(c("name")).alias("title"), X.initial(c("name")).alias("initial")).agg(F.min("pre_id").alias("id")).where("initial IS NOT NULL")
    return L.best_ratio(left, right, ["initial"], 0.85, "sequence_ratio")


@register("match_journal")
def match_journal(s, d):
    j = table(s, d, "entities").where("type = 'Journal' AND name IS NOT NULL").select(c("entity_id").alias("id"), F.lower("name").alias("title"))
    r = table(s, d, "pre_entities").where("type = 'Journal' AND name IS NOT NULL").groupBy(F.lower("name").alias("title")).agg(F.min("pre_id").alias("id"))
    return L.best_ratio(j, r, [], 0.70, "sequence_ratio", 4)


@register("match_partial", f"WITH {REFS}, k AS (SELECT DISTINCT surname, year FROM refs), t AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL) SELECT doc_id, CAST(max(CASE WHEN contains(text, surname) THEN 0.65 ELSE 0.5 END) AS DOUBLE) AS confidence FROM (SELECT doc_id, text, CAST(unnest(list_distinct(regexp_extract_all(text, '(?:19|20)[0-9][0-9]'))) AS INTEGER) AS y FROM t) JOIN k ON y = year GROUP BY doc_id")
def match_partial(s, d):
    k = refs(s, d).select("surname", "year").distinct()
    t = table(s, d, "documents").where("text IS NOT NULL")
    years = t.select("doc_id", "text", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("(?:19|20)[0-9][0-9]"), F.lit(0)))).alias("y"))
    by_year = years.join(k, c("y").cast("int") == c("year"))
    return by_year.groupBy("doc_id").agg(F.max(F.when(F.contains("text", "surname"), 0.65).otherwise(0.5)).alias("confidence"))


WORDS = lambda t: f"list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(lower({t}), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda w: length(w) > 3))"


@register("match_keywords", f"WITH x AS (SELECT min(doc_id) AS id, {WORDS('title')} AS w FROM documents WHERE title IS NOT NULL GROUP BY title), y AS (SELECT eid, {WORDS('name')} AS v FROM (SELECT dense_rank() OVER (ORDER BY entity_id) AS eid, name FROM concepts)), p AS (SELECT id, eid, len(list_intersect(w, v)) AS overlap, len(v) AS n FROM x, y) SELECT eid AS id, CAST(max(overlap) AS INTEGER) AS overlap FROM p WHERE overlap >= 2 AND overlap::DOUBLE / n >= 0.5 GROUP BY 1")
def match_keywords(s, d):
    x = table(s, d, "documents").where("title IS NOT NULL").groupBy("title").agg(F.min("doc_id").alias("id")).select("id", "title")
    y = table(s, d, "concepts").select(F.dense_rank().over(Window.orderBy("entity_id")).cast("bigint").alias("id"), c("name").alias("title"))
    return L.keyword_matches(y, x).select("id", "overlap")


@register("link_exact", "WITH a AS (SELECT doc_id, trim(lower(title)) AS k FROM raw_documents WHERE title IS NOT NULL), b AS (SELECT trim(lower(title)) AS k, min(doc_id) AS other FROM documents WHERE title IS NOT NULL GROUP BY 1) SELECT DISTINCT doc_id, other FROM a JOIN b USING (k)")
def link_exact(s, d):
    a = table(s, d, "raw_documents").where("title IS NOT NULL").select("doc_id", F.trim(F.lower("title")).alias("k"))
    b = table(s, d, "documents").where("title IS NOT NULL").groupBy(F.trim(F.lower("title")).alias("k")).agg(F.min("doc_id").alias("other"))
    return a.join(b, "k").select("doc_id", "other").distinct()


def _titles(s, d, name):
    t = table(s, d, name).where("title IS NOT NULL").groupBy(c("doc_id").cast("string").alias("id")).agg(F.min(X.match_key_spaced(c("title"))).alias("title"))
    return t.where(F.length("title") >= 10)


def _by_title(s, d, ids=None):
    """The links by title, of all raw documents or of those with these ids."""
    left = _titles(s, d, "raw_documents")
    return L.best_ratio(left if ids is None else left.join(ids, "id", "left_semi"), _titles(s, d, "documents"), [], 0.60, "sequence_ratio", 24, others=1)


@register("link_title")
def link_title(s, d):
    return _by_title(s, d).withColumn("tier", F.when(c("score") >= 0.85, "high").when(c("score") >= 0.70, "medium").otherwise("low"))


def _by_abstract(s, d, ids=None):
    docs = table(s, d, "raw_documents").where("text IS NOT NULL").select(c("doc_id").alias("id"), "text", (c("source_type") != "regulation").alias("paper"))
    head = lambda t: docs.groupBy("id").agg(F.min(F.substring(X.match_key_spaced(t), 1, 800)).alias("title")).where(F.length("title") >= 100)
    left = head(c("text"))
    cleaned = written(head(X.clean_text(c("text"), c("paper"))), "abstracts")
    parts = 16
    if ids is not None:  # each part of the left rates all others anew: no more parts than the rows are worth
        left = left.join(ids, "id", "left_semi")
        parts = max(1, min(parts, ids.count() // 2500))
    return L.best_ratio(left, cleaned, [], 0.60, "sequence_ratio", parts, others=max(10, 24 // parts))


@register("link_abstract")
def link_abstract(s, d):
    """Raw texts against the same collection's cleaned ones: markup, images and references gone, the beginning still tells them."""
    return _by_abstract(s, d)


@register("link_cascade")
def link_cascade(s, d):
    """Each stage rates only what no earlier one has linked."""
    every = table(s, d, "raw_documents").select(c("doc_id").alias("id")).distinct()
    exact = link_exact(s, d).select(c("doc_id").alias("id"), c("other").cast("string").alias("other"))
    rest = every.join(exact, "id", "left_anti")
    title = written(_by_title(s, d, rest), "titles")
    abstract = written(_by_abstract(s, d, rest.join(title, "id", "left_anti")), "links")
    return L.cascade(every, ("exact", exact), ("title", title), ("abstract", abstract))


@register("enrich_report", f"WITH {REFS} SELECT count(*) AS refs, count(DISTINCT doc_id) AS citing, count(DISTINCT journal) AS journals, round(CAST(count(*) AS DOUBLE) / count(DISTINCT doc_id), 2) AS per_document FROM refs")
def enrich_report(s, d):
    return refs(s, d).agg(F.count(F.lit(1)).alias("refs"), F.countDistinct("doc_id").alias("citing"), F.countDistinct("journal").alias("journals"), F.round(F.count(F.lit(1)) / F.countDistinct("doc_id"), 2).alias("per_document"))


@register("chunk_to_paper", "WITH k AS (SELECT DISTINCT chunk_id, string_split(chunk_id, '_CHUNK_')[1] AS doc FROM chunks), p AS (SELECT DISTINCT doc_id FROM cleaned_documents) SELECT chunk_id, doc_id FROM k LEFT JOIN p ON doc = doc_id")
def chunk_to_paper(s, d):
    k = table(s, d, "chunks").select("chunk_id", F.element_at(F.split("chunk_id", "_CHUNK_"), 1).alias("doc")).distinct()
    p = table(s, d, "cleaned_documents").select("doc_id").distinct()
    return k.join(p, c("doc") == c("doc_id"), "left").select("chunk_id", "doc_id")


@register("citation_lookup", "WITH p AS (SELECT DISTINCT doc_id FROM cleaned_documents), v AS (SELECT doc_id, doc_id AS k FROM p UNION ALL SELECT doc_id, regexp_extract(doc_id, '([0-9]+)$', 1) FROM p) SELECT k, min(doc_id) AS doc_id FROM v GROUP BY k")
def citation_lookup(s, d):
    p = table(s, d, "cleaned_documents").select("doc_id").distinct()
    return p.select("doc_id", F.explode(F.array("doc_id", F.regexp_extract("doc_id", "([0-9]+)$", 1))).alias("k")).groupBy("k").agg(F.min("doc_id").alias("doc_id"))


@register("issn_join", "WITH x AS (SELECT DISTINCT chunk_id, unnest(document_ids) AS doc_id, generate_subscripts(document_ids, 1) AS pos FROM chunks), p AS (SELECT doc_id, min(source_type) AS kind FROM cleaned_documents GROUP BY doc_id) SELECT chunk_id, arg_min(kind, pos) AS kind FROM x JOIN p USING (doc_id) WHERE kind IS NOT NULL GROUP BY chunk_id")
def issn_join(s, d):
    """Of several ids of a row the first that the other side knows."""
    x = table(s, d, "chunks").select("chunk_id", F.posexplode("document_ids").alias("at", "doc_id")).distinct()
    p = table(s, d, "cleaned_documents").groupBy("doc_id").agg(F.min("source_type").alias("kind")).where("kind IS NOT NULL")
    return x.join(p, "doc_id").groupBy("chunk_id").agg(F.min_by("kind", "at").alias("kind"))


@register("contains_edges", "WITH x AS (SELECT chunk_id, unnest(document_ids) AS doc FROM chunks) SELECT DISTINCT string_split(doc, '_')[2] AS src, chunk_id AS dst FROM x WHERE starts_with(doc, 'reg_')")
def contains_edges(s, d):
    return table(s, d, "chunks").select("chunk_id", F.explode("document_ids").alias("doc")).where(F.startswith("doc", F.lit("reg_"))).select(F.element_at(F.split("doc", "_"), 2).alias("src"), c("chunk_id").alias("dst")).distinct()


@register("jurisdiction_link", "WITH k AS (SELECT DISTINCT string_split(doc_id, '_')[2] AS code FROM raw_documents WHERE starts_with(doc_id, 'reg_')) SELECT doc_id, jurisdiction FROM documents WHERE jurisdiction IN (SELECT code FROM k)")
def jurisdiction_link(s, d):
    k = table(s, d, "raw_documents").where(F.startswith("doc_id", F.lit("reg_"))).select(F.element_at(F.split("doc_id", "_"), 2).alias("jurisdiction")).distinct()
    return table(s, d, "documents").join(k, "jurisdiction", "left_semi").select("doc_id", "jurisdiction")


@register("edge_categorise", "WITH x AS (SELECT chunk_id, unnest(document_ids) AS doc FROM chunks) SELECT CASE WHEN starts_with(doc, 'reg_') THEN 'CONTAINS_JURISDICTION' WHEN starts_with(doc, 'paper_') THEN 'CONTAINS_PUBLICATION' ELSE 'UNKNOWN' END AS category, count(*) AS n FROM x GROUP BY 1")
def edge_categorise(s, d):
    kind = F.when(F.startswith("doc", F.lit("reg_")), "CONTAINS_JURISDICTION").when(F.startswith("doc", F.lit("paper_")), "CONTAINS_PUBLICATION").otherwise("UNKNOWN")
    return table(s, d, "chunks").select(F.explode("document_ids").alias("doc")).groupBy(kind.alias("category")).agg(F.count(F.lit(1)).alias("n"))


@register("cites_union", f"WITH {REFS}, a AS (SELECT DISTINCT doc_id AS src, lower(title) AS dst, 1 AS source FROM refs), b AS (SELECT DISTINCT doc_id AS src, lower(title) AS dst, 2 AS source FROM refs WHERE year >= 2015) SELECT src, dst, CAST(min(source) AS INTEGER) AS source FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY src, dst")
def cites_union(s, d):
    r = refs(s, d)
    one = r.select(c("doc_id").alias("src"), F.lower("title").alias("dst"), F.lit(1).alias("source")).distinct()
    two = r.where("year >= 2015").select(c("doc_id").alias("src"), F.lower("title").alias("dst"), F.lit(2).alias("source")).distinct()
    return E.first_of(one.unionByName(two), ["src", "dst"], c("source"))


@register("enrichment_edges", f"WITH {REFS} SELECT DISTINCT 'CITES' AS rel, CAST(doc_id AS VARCHAR) AS src, lower(title) AS dst FROM refs UNION ALL SELECT DISTINCT 'PUBLISHED_IN', lower(title), journal FROM refs UNION ALL SELECT DISTINCT 'AUTHORED_BY', lower(title), surname || ', ' || initial || '.' FROM refs")
def enrichment_edges(s, d):
    r = refs(s, d)
    edge = lambda rel, src, dst: r.select(F.lit(rel).alias("rel"), src.alias("src"), dst.alias("dst")).distinct()
    return edge("CITES", c("doc_id").cast("string"), F.lower("title")).unionByName(edge("PUBLISHED_IN", F.lower("title"), c("journal"))).unionByName(edge("AUTHORED_BY", F.lower("title"), F.concat("surname", F.lit(", "), "initial", F.lit("."))))


@register(
    "resolve_exact_alias",
    "WITH qy AS (SELECT DISTINCT name FROM pre_entities WHERE name IS NOT NULL), x AS (SELECT trim(lower(name)) AS k, min(entity_id) AS entity_id FROM entities WHERE name IS NOT NULL GROUP BY 1), al AS (SELECT trim(lower(alias)) AS k, min(entity_id) AS entity_id FROM (SELECT entity_id, unnest(aliases) AS alias FROM entities) GROUP BY 1) SELECT qy.name AS name, coalesce(x.entity_id, al.entity_id) AS entity_id, CASE WHEN x.entity_id IS NOT NULL THEN 'exact' ELSE 'alias' END AS match_type, CAST(CASE WHEN x.entity_id IS NOT NULL THEN 1.0 ELSE 0.95 END AS DOUBLE) AS confidence FROM qy LEFT JOIN x ON trim(lower(qy.name)) = x.k LEFT JOIN al ON trim(lower(qy.name)) = al.k WHERE x.entity_id IS NOT NULL OR al.entity_id IS NOT NULL",
)
def resolve_exact_alias(s, d):
    e = table(s, d, "entities")
    names = table(s, d, "pre_entities").where("name IS NOT NULL").select("name").distinct().withColumn("k", F.trim(F.lower("name")))
    x = e.where("name IS NOT NULL").groupBy(F.trim(F.lower("name")).alias("k")).agg(F.min("entity_id").alias("x"))
    al = e.select("entity_id", F.explode("aliases").alias("alias")).groupBy(F.trim(F.lower("alias")).alias("k")).agg(F.min("entity_id").alias("a"))
    j = names.join(x, "k", "left").join(al, "k", "left").where("x IS NOT NULL OR a IS NOT NULL")
    return j.select("name", F.coalesce("x", "a").alias("entity_id"), F.when(c("x").isNotNull(), "exact").otherwise("alias").alias("match_type"), F.when(c("x").isNotNull(), 1.0).otherwise(0.95).alias("confidence"))


@register("resolution_metrics", "WITH qy AS (SELECT DISTINCT name FROM pre_entities WHERE name IS NOT NULL), x AS (SELECT DISTINCT trim(lower(name)) AS k FROM entities WHERE name IS NOT NULL) SELECT count(*) AS n, count(k) AS resolved, round(count(k)::DOUBLE / count(*), 6) AS rate FROM qy LEFT JOIN x ON trim(lower(name)) = k")
def resolution_metrics(s, d):
    names = table(s, d, "pre_entities").where("name IS NOT NULL").select("name").distinct().withColumn("k", F.trim(F.lower("name")))
    x = table(s, d, "entities").where("name IS NOT NULL").select(F.trim(F.lower("name")).alias("k")).distinct().withColumn("hit", F.lit(1))
    return names.join(x, "k", "left").agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("resolved"), F.round(F.count("hit") / F.count(F.lit(1)), 6).alias("rate"))
