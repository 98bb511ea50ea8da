"""Citations, model answers, query sets and resumable work, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tesselar.functions import answers as A
from tesselar.functions import text as X
from tesselar.functions import values as V
from tesselar.operators import citations as C
from tesselar.operators import linkage as L
from tesselar.operators.progress import Ledger
from tesselar.plans import graph_tables as T
from tesselar.plans.link_queries import REFS, refs
from tesselar.plans.registry import register
from tesselar.plans.text_queries import q
from tesselar.session import table
from tesselar.sources import documents as D
from tesselar.storage import place_for

c = F.col
IN = lambda names: "(" + ", ".join(q(n) for n in names) + ")"
MENTIONED = "SELECT DISTINCT chunk_id, name, type FROM pre_entities WHERE name IS NOT NULL AND chunk_id IS NOT NULL"
DISCUSS = f"m AS ({MENTIONED}), one AS (SELECT chunk_id, name AS subject, type, row_number() OVER (PARTITION BY chunk_id ORDER BY name, type) AS i FROM m WHERE type IN {IN(V.ACADEMIC_TYPES)}), two AS (SELECT chunk_id, object, row_number() OVER (PARTITION BY chunk_id ORDER BY object) AS i FROM (SELECT DISTINCT chunk_id, name AS object FROM m WHERE type IN {IN(V.CONCEPT_TYPES)})), dis AS (SELECT one.chunk_id AS chunk_id, subject, type, object FROM one JOIN two ON one.chunk_id = two.chunk_id WHERE one.i <= 10 AND two.i <= 15)"


def _mentions(s, d):
    return table(s, d, "pre_entities").where("name IS NOT NULL AND chunk_id IS NOT NULL").select("chunk_id", "name", "type").distinct()


@register("discusses", f"WITH {DISCUSS} SELECT chunk_id, subject, type, object FROM dis")
def discusses(s, d):
    return C.discusses(_mentions(s, d)).select("chunk_id", "subject", "type", "object")


@register("identify_citations", f"WITH {DISCUSS}, w AS (SELECT subject, list_sort(list(DISTINCT object)) AS objects FROM dis GROUP BY subject) SELECT entity_id, name, type, objects FROM entities JOIN w ON name = subject WHERE type IN {IN(V.ACADEMIC_TYPES)}")
def identify_citations(s, d):
    return C.identify(table(s, d, "entities"), C.discusses(_mentions(s, d)))


def _cited(s, d):
    """Mentions with the number of the document that their chunk comes from."""
    e = table(s, d, "pre_entities").where("name IS NOT NULL AND type IS NOT NULL")
    document = F.nullif(F.regexp_extract("chunk_id", r"_0*(\d+)_CHUNK_", 1), F.lit("")).cast("bigint")
    return e.select(c("pre_id").alias("entity_id"), "name", "type", document.alias("document")).where("document IS NOT NULL").distinct()


@register("match_reference")
def match_reference(s, d):
    """Mentions against the references of the document that their chunk comes from, in three tiers."""
    r = refs(s, d).withColumnRenamed("doc_id", "document")
    return C.match_references(_cited(s, d), r).withColumn("confidence", F.round("confidence", 6))


@register("match_stats")
def match_stats(s, d):
    m = match_reference(s, d).groupBy("method").agg(F.count(F.lit(1)).alias("n"))
    return m


OWN = r"SELECT DISTINCT pre_id AS entity_id, name, type, CASE WHEN contains(name, ',') THEN trim(string_split(name, ',')[1]) ELSE regexp_split_to_array(trim(name), ' +')[-1] END AS own, TRY_CAST(nullif(regexp_extract(chunk_id, '_0*(\d+)_CHUNK_', 1), '') AS BIGINT) AS document, TRY_CAST(nullif(regexp_extract(name, '(?:^|[^0-9A-Za-z_])((?:19|20)[0-9]{2})(?:$|[^0-9A-Za-z_])', 1), '') AS INTEGER) AS y FROM pre_entities WHERE name IS NOT NULL AND type IS NOT NULL"


@register(
    "match_year_surname",
    f"WITH {REFS}, e AS ({OWN}), p AS (SELECT entity_id, CASE WHEN y IS NOT NULL AND own <> '' AND y = year AND contains(lower(surname), lower(own)) THEN 0.65 WHEN y IS NULL AND own <> '' AND starts_with(lower(surname), lower(own)) THEN 0.60 WHEN y IS NOT NULL AND own = '' AND y = year THEN 0.50 END AS k FROM e JOIN refs ON document = doc_id) SELECT entity_id, CAST(max(k) AS DOUBLE) AS confidence FROM p WHERE k IS NOT NULL GROUP BY entity_id",
)
def match_year_surname(s, d):
    """The third tier by itself."""
    pairs = _cited(s, d).join(refs(s, d), c("document") == c("doc_id"))
    k = C.partial_confidence(C.year_of(c("name")), X.surname(c("name")), c("year"), c("surname"))
    return pairs.select("entity_id", k.alias("k")).where("k IS NOT NULL").groupBy("entity_id").agg(F.max("k").alias("confidence"))


@register("l1_overlap")
def l1_overlap(s, d):
    """References that are documents of the collection: the first of the same year with a title at least .90 alike."""
    left = refs(s, d).groupBy("year", X.match_key(c("title")).alias("title")).agg(F.min(F.struct("doc_id", "place")).alias("r"))
    left = left.select(F.concat_ws("#", c("r.doc_id").cast("string"), c("r.place").cast("string")).alias("id"), "year", "title").where("title <> ''")
    right = table(s, d, "documents").where("title IS NOT NULL AND fetched_at IS NOT NULL").select(c("doc_id").alias("id"), F.year("fetched_at").alias("year"), X.match_key(c("title")).alias("title"))
    return L.best_ratio(left, right, ["year"], 0.90, first=True)


@register("extract_year", r"SELECT doc_id, TRY_CAST(nullif(regexp_extract(text, '(?:^|[^0-9A-Za-z_])((?:19|20)[0-9]{2})(?:$|[^0-9A-Za-z_])', 1), '') AS INTEGER) AS year FROM documents WHERE text IS NOT NULL")
def extract_year(s, d):
    return table(s, d, "documents").where("text IS NOT NULL").select("doc_id", C.year_of(c("text")).alias("year"))


@register("norm_text", r"SELECT doc_id, trim(regexp_replace(regexp_replace(lower(title), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g')) AS tight, CASE WHEN trim(regexp_replace(regexp_replace(lower(title), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')) = 'unknown' THEN '' ELSE trim(regexp_replace(regexp_replace(lower(title), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')) END AS spaced FROM documents WHERE title IS NOT NULL")
def norm_text(s, d):
    return table(s, d, "documents").where("title IS NOT NULL").select("doc_id", X.match_key(c("title")).alias("tight"), X.match_key_spaced(c("title")).alias("spaced"))


VEC = "CAST(embedding AS DOUBLE[])"


@register("l2_normalize", f"WITH x AS (SELECT vec_id, list_transform({VEC}, lambda v: v / sqrt(list_inner_product({VEC}, {VEC}))) AS u FROM embeddings) SELECT vec_id, round(u[1], 5) AS head, round(u[-1], 5) AS tail, round(list_inner_product(u, u), 5) AS norm FROM x")
def l2_normalize(s, d):
    from tesselar.operators.similarity import dot, unit

    x = table(s, d, "embeddings").select("vec_id", unit(c("embedding")).alias("u"))
    return x.select("vec_id", F.round(F.get("u", F.lit(0)), 5).alias("head"), F.round(F.element_at("u", -1), 5).alias("tail"), F.round(dot(c("u"), c("u")), 5).alias("norm"))


@register("centroid_distance", f"WITH p AS (SELECT label, unnest({VEC}) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, avg(v) AS a FROM p GROUP BY ALL), k AS (SELECT label, list(a ORDER BY i) AS mid FROM m GROUP BY label) SELECT vec_id, round(1 - list_inner_product({VEC}, mid) / sqrt(list_inner_product({VEC}, {VEC}) * list_inner_product(mid, mid)), 4) AS distance FROM embeddings JOIN k USING (label)")
def centroid_distance(s, d):
    """How far each vector is from its label's mean; the means are added up place by place, never gathered."""
    from tesselar.operators.similarity import cosine

    e = table(s, d, "embeddings")
    means = e.select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg("v").alias("a"))
    mid = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "a"))), lambda x: x["a"]).alias("mid"))
    return e.join(mid, "label").select("vec_id", F.round(1 - cosine(c("embedding"), c("mid")), 4).alias("distance"))


NAMED = "n AS (SELECT DISTINCT pre_id, name, type FROM pre_entities WHERE name IS NOT NULL AND type IS NOT NULL)"


def _named(s, d):
    return table(s, d, "pre_entities").where("name IS NOT NULL AND type IS NOT NULL").select("pre_id", "name", "type").distinct()


@register("parse_llm_json", f"WITH {NAMED} SELECT pre_id, name, type FROM n WHERE pre_id % 5 < 3")
def parse_llm_json(s, d):
    """Answers in five forms (fenced, bare, wrapped, empty, cut off) made of all mentions and read back."""
    one = F.to_json(F.array(F.struct("name", "type")))
    form = c("pre_id") % 5
    answer = F.when(form == 0, F.concat(F.lit("```json\n"), one, F.lit("\n```"))).when(form == 1, one).when(form == 2, F.concat(F.lit('{"entities": '), one, F.lit("}"))).when(form == 3, "[]").otherwise(F.substr(one, F.lit(1), F.length(one) - 3))
    return _named(s, d).select("pre_id", F.explode(A.entities(answer)).alias("e")).select("pre_id", "e.name", "e.type")


@register("recover_json", f"WITH m AS (SELECT DISTINCT pre_id, chunk_id, name, type FROM pre_entities WHERE name IS NOT NULL AND type IS NOT NULL AND chunk_id IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY pre_id DESC, name, type) AS i FROM m) SELECT chunk_id, name AS subject, type AS object, CAST(1.0 AS DOUBLE) AS confidence FROM r WHERE i > 1")
def recover_json(s, d):
    """Answers about each chunk cut off within the last relation: all before it come out."""
    m = table(s, d, "pre_entities").where("name IS NOT NULL AND type IS NOT NULL AND chunk_id IS NOT NULL").select("pre_id", "chunk_id", "name", "type").distinct()
    w = Window.partitionBy("chunk_id").orderBy(F.desc("pre_id"), "name", "type")
    one = F.struct((-F.row_number().over(w)).alias("i"), F.struct(c("name").alias("subject"), F.lit("mentions").alias("predicate"), c("type").alias("object")).alias("r"))
    held = m.select("chunk_id", one.alias("o")).groupBy("chunk_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list("o")), lambda x: x["r"])).alias("j"))
    answer = F.concat(F.lit('Here it is: {"relations": '), F.substr("j", F.lit(1), F.length("j") - 3))
    return held.select("chunk_id", F.explode(A.relations(answer)).alias("r")).select("chunk_id", "r.subject", "r.object", "r.confidence")


@register("parse_score", "SELECT event_id, CASE WHEN event_id % 5 = 4 THEN 0.0 ELSE round(value, 2) END AS score FROM events WHERE value IS NOT NULL")
def parse_score(s, d):
    v = F.concat(F.lit('"score": '), F.format_string("%.2f", F.round("value", 2)))
    form = c("event_id") % 5
    answer = F.when(form == 0, F.concat(F.lit("{"), v, F.lit(', "explanation": "x"}'))).when(form == 1, F.concat(F.lit("```json\n{"), v, F.lit("}\n```"))).when(form == 2, F.concat(F.lit("So I say {"), v, F.lit("} here."))).when(form == 3, F.concat(F.lit("{"), v, F.lit(', "explan'))).otherwise("no idea")
    return table(s, d, "events").where("value IS NOT NULL").select("event_id", A.score(answer).alias("score"))


@register("query_filter", "SELECT doc_id, map_extract(metadata, 'country_code')[1] AS tag FROM raw_documents WHERE map_extract(metadata, 'source')[1] = 'law tracker'")
def query_filter(s, d):
    """Rows by the value of a tag."""
    return table(s, d, "raw_documents").where(c("metadata")["source"] == "law tracker").select("doc_id", c("metadata")["country_code"].alias("tag"))


ALL_TYPES = list(dict.fromkeys(V.SEMANTIC_TYPES + V.METADATA_TYPES))


@register("query_entities", f"SELECT DISTINCT name, type FROM pre_entities WHERE name IS NOT NULL AND type IN {IN(ALL_TYPES)}")
def query_entities(s, d):
    """Entities of a query that have a name and a type that is known."""
    return table(s, d, "pre_entities").where(c("name").isNotNull() & c("type").isin(ALL_TYPES)).select("name", "type").distinct()


@register("elapsed_eta", "WITH x AS (SELECT user_id, min(ts) AS a, max(ts) AS b, count(*) AS n FROM events GROUP BY user_id) SELECT user_id, strftime(a, '%Y-%m-%dT%H:%M:%S') AS started, round((epoch_us(b) - epoch_us(a)) / 1e6, 3) AS elapsed, round((epoch_us(b) - epoch_us(a)) / 1e6 / n * (1000 - n), 3) AS eta FROM x")
def elapsed_eta(s, d):
    """ISO start, seconds gone by, and seconds left if 1,000 are to be done at the pace so far."""
    x = table(s, d, "events").groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count(F.lit(1)).alias("n"))
    micros = lambda v: F.unix_micros(c(v).cast("timestamp"))
    gone = (micros("b") - micros("a")) / 1e6
    return x.select("user_id", F.date_format("a", "yyyy-MM-dd'T'HH:mm:ss").alias("started"), F.round(gone, 3).alias("elapsed"), F.round(gone / c("n") * (1000 - c("n")), 3).alias("eta"))


LONG = lambda t, n: f"list_distinct(list_filter(regexp_split_to_array(lower({t}), '[^a-z0-9]+'), lambda w: length(w) >= {n}))"
BEST = f"ch AS (SELECT chunk_id, min(text) AS text FROM chunks WHERE text IS NOT NULL GROUP BY chunk_id), qw AS (SELECT item_id AS query, unnest({LONG('text', 8)}) AS w FROM eval_items WHERE text IS NOT NULL), tw AS (SELECT chunk_id, unnest({LONG('text', 8)}) AS w FROM ch), sh AS (SELECT query, chunk_id, count(*) AS shared FROM tw JOIN qw USING (w) GROUP BY ALL), best AS (SELECT query, chunk_id, shared, CAST(row_number() OVER (PARTITION BY query ORDER BY shared DESC, chunk_id) AS INTEGER) AS rank FROM sh QUALIFY rank <= 3)"


def _chunk_texts(s, d):
    return table(s, d, "chunks").where("text IS NOT NULL").groupBy("chunk_id").agg(F.min("text").alias("text"))


def _items(s, d):
    return table(s, d, "eval_items").where("text IS NOT NULL").select(c("item_id").alias("query"), "text")


@register("best_chunks", f"WITH {BEST} SELECT query, chunk_id, shared, rank FROM best")
def best_chunks(s, d):
    return C.best_chunks(_items(s, d), _chunk_texts(s, d))


@register("answer_extract", f"WITH {BEST} SELECT query, string_agg(string_split(text, '. ')[1] || ' [' || rank || ']', ' ' ORDER BY rank) AS answer FROM best JOIN ch USING (chunk_id) GROUP BY query")
def answer_extract(s, d):
    chunks = _chunk_texts(s, d)
    return C.answers(chunks, C.best_chunks(_items(s, d), chunks))


@register("judge_answers", f"WITH {BEST}, x AS (SELECT query, {LONG('i.text', 4)} AS a, {LONG('ch.text', 4)} AS k, {LONG('split_part(i.text, chr(63), 1)', 4)} AS ask, {LONG('array_to_string(string_split(i.text, chr(63))[2:], chr(63))', 4)} AS said FROM best JOIN ch USING (chunk_id) JOIN eval_items i ON i.item_id = query WHERE rank = 1) SELECT query, round(len(list_intersect(a, k))::DOUBLE / len(a), 6) AS faithfulness, round(CASE WHEN len(ask) > 0 THEN len(list_intersect(ask, said))::DOUBLE / len(ask) ELSE 0 END, 6) AS relevancy FROM x")
def judge_answers(s, d):
    """Share of an answer's words that the best chunk has, and of the question's words that the answer takes up. A stand-in for a model."""
    from tesselar.functions.models import support_score

    items, chunks = _items(s, d), _chunk_texts(s, d)
    top = C.best_chunks(items, chunks).where("rank = 1").join(chunks.withColumnRenamed("text", "context"), "chunk_id").join(items, "query")
    w = lambda x: C.word_set(x, 4)
    asked, said = F.split_part("text", F.lit("?"), F.lit(1)), F.array_join(F.slice(F.split("text", r"\?"), 2, 1_000_000), "?")
    return top.select("query", F.round(support_score(w(c("text")), w(c("context"))), 6).alias("faithfulness"), F.round(support_score(w(asked), w(said)), 6).alias("relevancy"))


@register("resume_run", "WITH x AS (SELECT chunk_id, max(CASE WHEN text IS NOT NULL THEN 1 ELSE 0 END) AS ok FROM chunks GROUP BY chunk_id) SELECT count(*) AS total, count(*) FILTER (WHERE ok = 1) AS done, count(*) FILTER (WHERE ok = 0) AS failed, 0::BIGINT AS open FROM x")
def resume_run(s, d):
    """A job over all chunks that is broken off after the regulations and taken up again; rows without text are failures."""
    rows = table(s, d, "chunks").groupBy("chunk_id").agg(F.max("text").alias("text"))
    ledger = Ledger(s, place_for(s, "ledger"), "chunk_id", "string")

    def work(text):
        if text is None:
            raise ValueError("no text")
        return str(len(text))

    ledger.run(rows.where("chunk_id LIKE 'reg%'"), work, "text")
    ledger.run(rows, work, "text")
    return ledger.progress(rows)


@register("truncate_graph", T.GRAPH + "SELECT label, count(*) AS before, 0::BIGINT AS after FROM nodes GROUP BY label")
def truncate_graph(s, d):
    place = place_for(s, "graph")
    D.write_graph(T.nodes(s, d), T.edges(s, d), place)
    before = {r[0]: r[1] for r in s.read.parquet(f"{place}/nodes").groupBy("label").count().collect()}  # a row for each of five labels
    D.truncate_graph(s, place)
    after = s.read.parquet(f"{place}/nodes").groupBy("label").agg(F.count(F.lit(1)).alias("after"))
    counted = s.createDataFrame(sorted(before.items()), "label string, before bigint")
    return counted.join(after, "label", "left").select("label", "before", F.coalesce("after", F.lit(0).cast("bigint")).alias("after"))


@register("scan_jsonl", "SELECT doc_id, title, lang FROM documents")
def scan_jsonl(s, d):
    """Documents as JSON lines between blank ones, read back."""
    place = place_for(s, "jsonl")
    table(s, d, "documents").select(F.concat(F.to_json(F.struct("doc_id", "title", "lang")), F.lit("\n")).alias("value")).write.text(place)
    return D.read_lines(s, place, "doc_id bigint, title string, lang string").where("doc_id IS NOT NULL")


@register("scan_json_map", "SELECT entity_id AS key, name, type FROM concepts")
def scan_json_map(s, d):
    """The concepts, a fixed table, as one JSON object of objects, read back."""
    place = place_for(s, "map")
    entry = F.struct(c("entity_id").alias("key"), F.struct("name", "type").alias("value"))
    table(s, d, "concepts").agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value")).coalesce(1).write.text(place)
    return D.read_map(s, place, "struct<name:string,type:string>").select("key", "value.name", "value.type")


@register("scan_optional", "SELECT 'first' AS source, count(*) AS n FROM concepts UNION ALL SELECT 'fallback', count(*) FROM nation UNION ALL SELECT 'missing', 0")
def scan_optional(s, d):
    """The preferred of two inputs, the other where there is none, an empty table where there is neither."""
    of = lambda name, *paths: D.read_preferred(s, [f"{d}/{p}.parquet" for p in paths], "x int").agg(F.lit(name).alias("source"), F.count(F.lit(1)).alias("n"))
    return of("first", "concepts", "nation").unionByName(of("fallback", "no_such_table", "nation")).unionByName(of("missing", "no_such_table", "none_either"))


@register("csv_sinks", "SELECT doc_id, title, CAST(n_chars AS BIGINT) AS n_chars FROM documents WHERE title IS NOT NULL UNION ALL SELECT doc_id, title, CAST(n_chars AS BIGINT) FROM documents WHERE title IS NOT NULL AND lang = 'de'")
def csv_sinks(s, d):
    """A CSV table written, appended to, and read back."""
    place = place_for(s, "csv")
    rows = table(s, d, "documents").where("title IS NOT NULL").select("doc_id", "title", "n_chars")
    D.write_csv(rows, place)
    D.write_csv(table(s, d, "documents").where("title IS NOT NULL AND lang = 'de'").select("doc_id", "title", "n_chars"), place, append=True)
    return s.read.schema("doc_id bigint, title string, n_chars bigint").option("header", True).option("escape", '"').option("multiLine", True).csv(place)


PAD = lambda x: f"' ' || trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g')) || ' '"
LINES = f"{REFS}, rf AS (SELECT doc_id * 1000000 + place AS other, {PAD('surname || chr(32) || initial || chr(32) || title || chr(32) || journal')} AS text FROM refs)"


def _reference_texts(s, d):
    words = F.concat_ws(" ", "surname", "initial", "title", "journal")
    return refs(s, d).select((c("doc_id") * 1_000_000 + c("place")).alias("other"), words.alias("text"))


@register(
    "author_in_reference",
    f"WITH {LINES}, x AS (SELECT pre_id AS id, {PAD(chr(39) + chr(39) + ' || CASE WHEN contains(name, chr(44)) THEN trim(string_split(name, chr(44))[1]) ELSE regexp_split_to_array(trim(name), chr(32) || chr(43))[-1] END')} AS n, CASE WHEN contains(name, ',') THEN upper(trim(string_split(name, ',')[2])[1:1]) WHEN len(regexp_split_to_array(trim(name), ' +')) > 1 THEN upper(trim(name)[1:1]) END AS i FROM (SELECT DISTINCT pre_id, name FROM pre_entities WHERE type = 'Author' AND name IS NOT NULL)), p AS (SELECT id, other, CASE WHEN i IS NULL THEN 0.70 WHEN contains(text, ' ' || lower(i) || ' ') THEN 0.80 END AS k FROM x JOIN rf ON contains(text, n) WHERE trim(n) <> '') SELECT id, CAST(max(k) AS DOUBLE) AS confidence, min(other) AS first FROM p WHERE k IS NOT NULL GROUP BY id",
)
def author_in_reference(s, d):
    """Last tier of the author match: the surname as a word of a reference, with the initial .80, for names without one .70."""
    m = table(s, d, "pre_entities").where("type = 'Author' AND name IS NOT NULL").select(c("pre_id").alias("id"), X.surname(c("name")).alias("name"), X.initial(c("name")).alias("i")).distinct()
    hits = L.named_in(m.select("id", "name"), _reference_texts(s, d)).join(m.select("id", "i"), "id")
    k = F.when(c("i").isNull(), 0.70).when(F.contains("text", F.concat(F.lit(" "), F.lower("i"), F.lit(" "))), 0.80)
    return hits.withColumn("k", k).where("k IS NOT NULL").groupBy("id").agg(F.max("k").alias("confidence"), F.min("other").alias("first"))


@register("journal_in_reference", f"WITH {LINES}, x AS (SELECT DISTINCT pre_id AS id, {PAD('name')} AS n FROM pre_entities WHERE type = 'Journal' AND name IS NOT NULL AND length(name) >= 5) SELECT id, min(other) AS first, CAST(0.75 AS DOUBLE) AS confidence FROM x JOIN rf ON contains(text, n) WHERE trim(n) <> '' GROUP BY id")
def journal_in_reference(s, d):
    """Last tier of the journal match: a name of five letters or more in a reference, .75."""
    m = table(s, d, "pre_entities").where("type = 'Journal' AND name IS NOT NULL AND length(name) >= 5").select(c("pre_id").alias("id"), "name").distinct()
    return L.named_in(m, _reference_texts(s, d)).groupBy("id").agg(F.min("other").alias("first"), F.lit(0.75).alias("confidence"))
