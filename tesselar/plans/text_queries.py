"""Cleaning, parsing and splitting of texts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tesselar.functions import ids
from tesselar.functions import text as X
from tesselar.functions import values as V
from tesselar.plans.registry import register
from tesselar.session import table

c = F.col


def q(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def raw(s, d):
    return table(s, d, "raw_documents").where("text IS NOT NULL")


RAW = "raw_documents WHERE text IS NOT NULL"


@register("strip_html", rf"SELECT doc_id, md5(regexp_replace(text, '<[^>]+>', '', 'g')) AS digest, CAST(len(regexp_extract_all(text, '<[^>]+>')) AS INTEGER) AS fixes FROM {RAW}")
def strip_html(s, d):
    return raw(s, d).select("doc_id", F.md5(X.strip_html(c("text"))).alias("digest"), X.count_matches(c("text"), X.HTML_TAG).alias("fixes"))


@register("strip_images", rf"SELECT doc_id, md5(regexp_replace(text, '!\[[^\]]*\]\([^)]*\)', '', 'g')) AS digest, CAST(len(regexp_extract_all(text, '!\[[^\]]*\]\([^)]*\)')) AS INTEGER) AS fixes FROM {RAW}")
def strip_images(s, d):
    return raw(s, d).select("doc_id", F.md5(X.strip_images(c("text"))).alias("digest"), X.count_matches(c("text"), X.IMAGE).alias("fixes"))


@register("remove_emails", rf"SELECT doc_id, md5(regexp_replace(text, {q(X.EMAIL)}, '', 'g')) AS digest, CAST(len(regexp_extract_all(text, {q(X.EMAIL)})) AS INTEGER) AS fixes FROM {RAW}")
def remove_emails(s, d):
    return raw(s, d).select("doc_id", F.md5(X.remove_emails(c("text"))).alias("digest"), X.count_matches(c("text"), X.EMAIL).alias("fixes"))


def _latex_sql(text: str) -> str:
    for pattern, to in V.LATEX:
        text = f"regexp_replace({text}, {q(pattern)}, {q(to.replace('$1', chr(92) + '1'))}, 'g')"
    return text


@register("clean_latex", f"SELECT doc_id, md5({_latex_sql('text')}) AS digest FROM {RAW}")
def clean_latex(s, d):
    return raw(s, d).select("doc_id", F.md5(X.clean_latex(c("text"))).alias("digest"))


@register("normalize_ws", rf"SELECT doc_id, md5(trim(list_aggregate(list_transform(string_split(regexp_replace(regexp_replace(text, ' +', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), chr(10)), lambda x: trim(x)), 'string_agg', chr(10)))) AS digest FROM {RAW}")
def normalize_ws(s, d):
    return raw(s, d).select("doc_id", F.md5(X.normalize_space(c("text"))).alias("digest"))


@register("clean_text")
def clean_text(s, d):
    return raw(s, d).select("doc_id", X.clean_text(c("text"), c("source_type") == "academic_paper").alias("text")).withColumn("length", F.length("text"))


@register("drop_sections")
def drop_sections(s, d):
    return raw(s, d).select("doc_id", X.drop_sections(c("text")).alias("text"))


def _with_bibliography(s, d):
    """Documents with numbered references, these under a heading."""
    marked = F.regexp_replace("text", r"(?m)^\[1\] ", "# References\n[1] ")
    return table(s, d, "documents").where(c("text").rlike(r"(?m)^\[1\] [A-Z]")).select("doc_id", marked.alias("text"))


@register("extract_refs")
def extract_refs(s, d):
    return _with_bibliography(s, d).select("doc_id", F.length(X.without_references(c("text"))).alias("left"), F.size(X.split_references(X.reference_section(c("text")))).alias("references"))


@register("split_refs")
def split_refs(s, d):
    return _with_bibliography(s, d).select("doc_id", F.posexplode(X.split_references(X.reference_section(c("text")))).alias("place", "reference"))


@register("token_count", rf"SELECT chunk_id, CASE WHEN trim(regexp_replace(text, '\s+', ' ', 'g')) = '' THEN 0 ELSE CAST(len(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')) AS INTEGER) END AS tokens FROM chunks WHERE text IS NOT NULL")
def token_count(s, d):
    return table(s, d, "chunks").where("text IS NOT NULL").select("chunk_id", X.token_count(c("text")).alias("tokens"))


@register("sentences")
def sentences(s, d):
    return table(s, d, "chunks").where("text IS NOT NULL").select("chunk_id", F.posexplode(X.sentences(c("text"))).alias("place", "sentence"))


@register("pack_sentences")
def pack_sentences(s, d):
    return table(s, d, "cleaned_documents").where("text IS NOT NULL").select("doc_id", F.posexplode(X.pack(X.sentences(c("text")), 5000)).alias("place", "request"))


@register("norm_name", r"SELECT pre_id, trim(lower(regexp_replace(name, '\s+', ' ', 'g'))) AS normal FROM pre_entities WHERE name IS NOT NULL")
def norm_name(s, d):
    return table(s, d, "pre_entities").where("name IS NOT NULL").select("pre_id", X.normal_name(c("name")).alias("normal"))


@register("norm_predicate", r"SELECT DISTINCT description AS predicate, regexp_replace(trim(regexp_replace(lower(description), '[^a-z0-9\s]', '', 'g')), '\s+', '_', 'g') AS normal FROM pre_entities WHERE description IS NOT NULL")
def norm_predicate(s, d):
    return table(s, d, "pre_entities").where("description IS NOT NULL").select(c("description").alias("predicate"), X.normal_predicate(c("description")).alias("normal")).distinct()


@register(
    "name_parts",
    "SELECT DISTINCT name, CASE WHEN contains(name, ',') THEN trim(string_split(name, ',')[1]) ELSE regexp_split_to_array(trim(name), ' +')[-1] END AS surname, CASE WHEN contains(name, ',') THEN upper(trim(string_split(name, ',')[2])[1:1]) WHEN len(regexp_split_to_array(trim(name), ' +')) > 1 THEN upper(trim(name)[1:1]) END AS initial FROM entities WHERE type = 'Author' AND name IS NOT NULL",
)
def name_parts(s, d):
    return table(s, d, "entities").where("type = 'Author' AND name IS NOT NULL").select("name", X.surname(c("name")).alias("surname"), X.initial(c("name")).alias("initial")).distinct()


@register("infer_doc_type", "SELECT chunk_id, CASE WHEN starts_with(chunk_id, 'reg_') THEN 'regulation' WHEN starts_with(chunk_id, 'paper_') THEN 'paper' ELSE 'unknown' END AS doc_type, CASE WHEN starts_with(chunk_id, 'reg_') THEN string_split(chunk_id, '_')[2] END AS jurisdiction FROM chunks")
def infer_doc_type(s, d):
    return table(s, d, "chunks").select("chunk_id", X.doc_type(c("chunk_id")).alias("doc_type"), X.jurisdiction(c("chunk_id")).alias("jurisdiction"))


@register("truncate", "SELECT chunk_id, CASE WHEN length(text) > 200 THEN substring(text, 1, 200) || '... [truncated]' ELSE text END AS text FROM chunks WHERE text IS NOT NULL")
def truncate(s, d):
    return table(s, d, "chunks").where("text IS NOT NULL").select("chunk_id", X.truncated(c("text"), 200, "... [truncated]").alias("text"))


@register("cited_indices", r"SELECT doc_id, list_sort(list_distinct(list_transform(regexp_extract_all(text, '\[(\d{1,8})\]', 1), lambda x: CAST(x AS INTEGER)))) AS cited FROM documents WHERE text IS NOT NULL")
def cited_indices(s, d):
    found = F.regexp_extract_all("text", F.lit(r"\[(\d{1,8})\]"), F.lit(1))
    return table(s, d, "documents").where("text IS NOT NULL").select("doc_id", F.array_sort(F.array_distinct(F.transform(found, lambda x: x.cast("int")))).alias("cited"))


def _hints_sql(text: str, words: dict[str, str]) -> str:
    each = ", ".join(f"CASE WHEN regexp_matches({text}, {q(chr(92) + 'b(?:' + w + ')' + chr(92) + 'b')}) THEN {q(code)} END" for code, w in words.items())
    return f"list_filter([{each}], lambda x: x IS NOT NULL)"


def _hints(text, words: dict[str, str]):
    each = [F.when(text.rlike(rf"\b(?:{w})\b"), F.lit(code)) for code, w in words.items()]
    return F.filter(F.array(*each), lambda x: x.isNotNull())


@register("parse_jurisdictions", f"SELECT item_id, {_hints_sql('text', V.JURISDICTION_WORDS)} AS codes FROM eval_items")
def parse_jurisdictions(s, d):
    return table(s, d, "eval_items").select("item_id", _hints(c("text"), V.JURISDICTION_WORDS).alias("codes"))


@register("parse_doc_types", f"SELECT item_id, {_hints_sql('lower(text)', V.DOCUMENT_WORDS)} AS kinds FROM eval_items")
def parse_doc_types(s, d):
    return table(s, d, "eval_items").select("item_id", _hints(F.lower("text"), V.DOCUMENT_WORDS).alias("kinds"))


@register("norm_jurisdiction", "SELECT DISTINCT jurisdiction, CASE WHEN regexp_full_match(upper(trim(jurisdiction)), '[A-Z]{2}') THEN upper(trim(jurisdiction)) " + " ".join(f"WHEN trim(jurisdiction) = {q(n)} THEN {q(v)}" for n, v in V.JURISDICTION_ALIASES.items()) + " ELSE jurisdiction END AS code FROM documents WHERE jurisdiction IS NOT NULL")
def norm_jurisdiction(s, d):
    j = F.trim("jurisdiction")
    code = c("jurisdiction")
    for name, v in V.JURISDICTION_ALIASES.items():
        code = F.when(j == name, F.lit(v)).otherwise(code)
    return table(s, d, "documents").where("jurisdiction IS NOT NULL").select("jurisdiction", F.when(F.upper(j).rlike("^[A-Z]{2}$"), F.upper(j)).otherwise(code).alias("code")).distinct()


def _header_sql(line: str) -> str:
    of = lambda kind: f"regexp_matches({line}, {q('(?i)' + '|'.join('(?:' + p + ')' for p in V.HEADERS[kind]))})"
    return f"CASE WHEN source_type = 'regulation' THEN {of('regulation')} ELSE {of('paper')} END"


LINES = "lines AS (SELECT doc_id, source_type, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM documents WHERE text IS NOT NULL)"


def _lines(s, d):
    docs = table(s, d, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", "source_type", F.posexplode(F.split("text", "\n")).alias("at", "line")).select("doc_id", "source_type", (c("at") + 1).cast("bigint").alias("place"), "line")


def _is_header(line):
    """By the patterns of the document's kind."""
    return F.when(c("source_type") == "regulation", X.header_line(line, "regulation")).otherwise(X.header_line(line, "paper"))


@register("header_lines", f"WITH {LINES} SELECT doc_id, place, line FROM lines WHERE {_header_sql('line')}")
def header_lines(s, d):
    return _lines(s, d).where(_is_header(c("line"))).select("doc_id", "place", "line")


@register("garbage_header", "SELECT DISTINCT section_header AS header, " + " OR ".join(f"contains(lower(trim(regexp_replace(section_header, '^#+\\s*', ''))), {q(g.lower())})" for g in V.GARBAGE_HEADERS) + " AS garbage FROM chunks WHERE section_header IS NOT NULL")
def garbage_header(s, d):
    return table(s, d, "chunks").where("section_header IS NOT NULL").select(c("section_header").alias("header"), X.garbage_header(c("section_header")).alias("garbage")).distinct()


SECTIONS = f"""WITH {LINES}, marked AS (SELECT *, {_header_sql('line')} AS is_header FROM lines), numbered AS (SELECT *, CAST(sum(CASE WHEN is_header THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY place) AS BIGINT) AS section FROM marked),
 packed AS (SELECT doc_id, section, max(CASE WHEN is_header THEN line END) AS header, coalesce(string_agg(CASE WHEN is_header THEN NULL ELSE line END, chr(10) ORDER BY place), '') AS content FROM numbered GROUP BY doc_id, section) SELECT doc_id, section, header, md5(content) AS digest FROM packed WHERE trim(replace(content, chr(10), ' ')) <> ''"""


def sections(lines):
    """(doc_id, section, header, content): a header opens a section; one without content gives none."""
    is_header = _is_header(c("line"))
    running = Window.partitionBy("doc_id").orderBy("place")
    numbered = lines.withColumn("is_header", is_header).withColumn("section", F.sum(c("is_header").cast("bigint")).over(running))
    line = F.struct("place", "line")
    packed = numbered.groupBy("doc_id", "section").agg(F.max(F.when(c("is_header"), c("line"))).alias("header"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~c("is_header"), line))), lambda x: x["line"]), "\n").alias("content"))
    return packed.where(F.trim(F.replace("content", F.lit("\n"), F.lit(" "))) != "")


@register("split_sections", SECTIONS)
def split_sections(s, d):
    return sections(_lines(s, d)).select("doc_id", "section", "header", F.md5("content").alias("digest"))


@register("id_type", "SELECT chunk_id AS id, 'chunk' AS kind FROM chunks UNION ALL SELECT entity_id, CASE WHEN starts_with(entity_id, 'ent_') THEN 'entity' ELSE 'unknown' END FROM entities UNION ALL SELECT doc_id, 'unknown' FROM raw_documents")
def id_type(s, d):
    every = table(s, d, "chunks").select(c("chunk_id").alias("id")).unionByName(table(s, d, "entities").select(c("entity_id").alias("id"))).unionByName(table(s, d, "raw_documents").select(c("doc_id").alias("id")))
    return every.select("id", ids.id_type(c("id")).alias("kind"))


@register("entity_ids", "SELECT entity_id, 'ent_' || substring(sha256(trim(lower(name)) || '|' || trim(lower(type))), 1, 12) AS computed FROM entities WHERE name IS NOT NULL AND type IS NOT NULL")
def entity_ids(s, d):
    return table(s, d, "entities").where("name IS NOT NULL AND type IS NOT NULL").select("entity_id", ids.entity_id(c("name"), c("type")).alias("computed"))


@register("chunk_ids", r"SELECT chunk_id, regexp_extract(chunk_id, '^(.*)_CHUNK_(\d+)$', 1) AS document, CAST(regexp_extract(chunk_id, '^(.*)_CHUNK_(\d+)$', 2) AS INTEGER) AS place, printf('%s_CHUNK_%04d', regexp_extract(chunk_id, '^(.*)_CHUNK_(\d+)$', 1), CAST(regexp_extract(chunk_id, '^(.*)_CHUNK_(\d+)$', 2) AS INTEGER)) AS rebuilt FROM chunks")
def chunk_ids(s, d):
    document, place = ids.chunk_parts(c("chunk_id"))
    return table(s, d, "chunks").select("chunk_id", document.alias("document"), place.alias("place")).withColumn("rebuilt", ids.chunk_id(c("document"), c("place")))


DOI = r"""(10\.\d{4,9}/[^\s"<>\])]+)"""


@register("extract_doi", rf"WITH x AS (SELECT doc_id, regexp_extract(text, 'doi\.org/{DOI}', 1) AS linked, regexp_extract(text, '{DOI}', 1) AS plain, len(regexp_extract_all(text, '10\.\d{{4,9}}/')) AS n FROM documents WHERE text IS NOT NULL) SELECT doc_id, regexp_replace(CASE WHEN linked <> '' THEN linked WHEN n = 1 AND plain <> '' THEN plain END, '[.,;]+$', '') AS doi FROM x")
def extract_doi(s, d):
    return table(s, d, "documents").where("text IS NOT NULL").select("doc_id", X.doi(c("text")).alias("doi"))


@register("extract_titles", r"SELECT doc_id, unnest(list_filter(list_transform(string_split(text, chr(10))[1:30], lambda x: CASE WHEN starts_with(x, '# ') THEN trim(x[3:]) END), lambda x: x IS NOT NULL AND length(x) > 10)) AS title FROM raw_documents WHERE text IS NOT NULL")
def extract_titles(s, d):
    heads = F.transform(F.slice(F.split("text", "\n"), 1, 30), lambda x: F.when(F.startswith(x, F.lit("# ")), F.trim(F.substr(x, F.lit(3)))))
    return raw(s, d).select("doc_id", F.explode(F.filter(heads, lambda x: x.isNotNull() & (F.length(x) > 10))).alias("title"))


@register("extract_abstract")
def extract_abstract(s, d):
    marked = F.regexp_extract("text", r"(?is)(?:^|\n)#*\s*abstract\s*[:\n]+\s*(.{50,1500}?)(?:\n\s*\n|\n#)", 1)
    first = F.regexp_extract("text", r"(?s)^(?:#[^\n]*\n+|\s+)*(.+?)(?:\n\s*\n|\z)", 1)
    return raw(s, d).where("source_type = 'academic_paper'").select("doc_id", F.substring(F.when(marked != "", marked).otherwise(first), 1, 1500).alias("abstract"))


@register("html_links", rf"SELECT doc_id, unnest(regexp_extract_all(text, '<a\s+href=\"([^\"#][^\"]*)\"', 1)) AS link FROM {RAW}")
def html_links(s, d):
    return raw(s, d).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r'<a\s+href="([^"#][^"]*)"'), F.lit(1))).alias("link"))


@register("format_citation", "SELECT doc_id, title || ' (' || CAST(year(fetched_at) AS VARCHAR) || '). ' || CASE WHEN source_type = 'regulation' THEN 'Regulation tracker, ' || coalesce(jurisdiction, 'unknown') ELSE coalesce(source, 'unknown') END AS citation FROM documents WHERE title IS NOT NULL AND fetched_at IS NOT NULL")
def format_citation(s, d):
    place = F.when(c("source_type") == "regulation", F.concat(F.lit("Regulation tracker, "), F.coalesce("jurisdiction", F.lit("unknown")))).otherwise(F.coalesce("source", F.lit("unknown")))
    return table(s, d, "documents").where("title IS NOT NULL AND fetched_at IS NOT NULL").select("doc_id", F.concat("title", F.lit(" ("), F.year("fetched_at").cast("string"), F.lit("). "), place).alias("citation"))


@register("format_prompt", "SELECT chunk_id, '[' || chunk_id || '] ' || coalesce(section_header, 'no header') || ': ' || substring(text, 1, 80) AS line FROM chunks WHERE text IS NOT NULL")
def format_prompt(s, d):
    return table(s, d, "chunks").where("text IS NOT NULL").select("chunk_id", F.concat(F.lit("["), "chunk_id", F.lit("] "), F.coalesce("section_header", F.lit("no header")), F.lit(": "), F.substring("text", 1, 80)).alias("line"))


@register("preproc_report", "SELECT source_type, count(*) AS documents, CAST(sum(original_text_length) AS BIGINT) AS before, CAST(sum(cleaned_text_length) AS BIGINT) AS after, CAST(sum(reference_count) AS BIGINT) AS refs, count(*) FILTER (WHERE was_translated) AS translated FROM cleaned_documents GROUP BY source_type")
def preproc_report(s, d):
    return table(s, d, "cleaned_documents").groupBy("source_type").agg(F.count(F.lit(1)).alias("documents"), F.sum("original_text_length").alias("before"), F.sum("cleaned_text_length").alias("after"), F.sum("reference_count").alias("refs"), F.count_if("was_translated").alias("translated"))


@register("fix_totals", "SELECT k AS fix, CAST(sum(v) AS BIGINT) AS n FROM (SELECT unnest(map_keys(cleaning_fixes)) AS k, unnest(map_values(cleaning_fixes)) AS v FROM cleaned_documents) GROUP BY k")
def fix_totals(s, d):
    return table(s, d, "cleaned_documents").select(F.explode("cleaning_fixes").alias("fix", "v")).groupBy("fix").agg(F.sum("v").alias("n"))


@register("corpus_stats", "SELECT source_type, count(*) AS n, CAST(sum(length(text)) // count(*) AS BIGINT) AS mean_chars, count(DISTINCT year(fetched_at)) AS years FROM documents WHERE text IS NOT NULL GROUP BY source_type")
def corpus_stats(s, d):
    return table(s, d, "documents").where("text IS NOT NULL").groupBy("source_type").agg(F.count(F.lit(1)).alias("n"), F.expr("sum(length(text)) div count(1)").alias("mean_chars"), F.countDistinct(F.year("fetched_at")).alias("years"))


@register("corpus_union", "SELECT doc_id, source_type, title, length(text) AS chars FROM raw_documents UNION ALL SELECT doc_id, source_type, title, length(text) FROM cleaned_documents")
def corpus_union(s, d):
    one = lambda t: table(s, d, t).select("doc_id", "source_type", "title", F.length("text").cast("bigint").alias("chars"))
    return one("raw_documents").unionByName(one("cleaned_documents"), allowMissingColumns=True)


@register("stride_sample", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r FROM (SELECT DISTINCT doc_id FROM raw_documents)) WHERE r % 10 = 1")
def stride_sample(s, d):
    """Every tenth document in order: what the operator is for. Places come from partition offsets, not from one sorted partition."""
    ordered = table(s, d, "raw_documents").select("doc_id").distinct().orderBy("doc_id").withColumn("part", F.spark_partition_id())
    from tesselar.storage import written

    ordered = written(ordered, "ordered")
    sizes = ordered.groupBy("part").agg(F.count(F.lit(1)).alias("k"))
    offsets = F.broadcast(sizes.select("part", (F.sum("k").over(Window.orderBy("part")) - c("k")).alias("before")))
    place = F.row_number().over(Window.partitionBy("part").orderBy("doc_id"))
    return ordered.withColumn("r", place).join(offsets, "part").where((c("r") + c("before")) % 10 == 1).select("doc_id")


@register("chunk_stats", "SELECT round(avg(token_count), 6) AS mean, median(token_count) AS median, round(stddev_pop(token_count), 6) AS deviation, min(token_count) AS least, max(token_count) AS most, count(*) AS n FROM chunks WHERE token_count IS NOT NULL")
def chunk_stats(s, d):
    t = table(s, d, "chunks").where("token_count IS NOT NULL")
    return t.agg(F.round(F.avg("token_count"), 6).alias("mean"), F.percentile("token_count", F.lit(0.5)).alias("median"), F.round(F.stddev_pop("token_count"), 6).alias("deviation"), F.min("token_count").alias("least"), F.max("token_count").alias("most"), F.count(F.lit(1)).alias("n"))


QUALITY = "quality AS (SELECT chunk_id, token_count, sentence_count, section_header, CASE WHEN TRY_CAST(metadata['coherence'] AS DOUBLE) < 0.3 AND sentence_count > 1 THEN 'low coherence' WHEN token_count < 15 AND sentence_count = 1 THEN 'too short' WHEN sentence_count > 0 AND CAST(token_count AS DOUBLE) / sentence_count < 10 AND section_header IS NULL THEN 'sparse' END AS reason FROM chunks)"


def _quality(s, d):
    coherence = F.expr("try_cast(metadata['coherence'] AS DOUBLE)")
    t, n = c("token_count"), c("sentence_count")
    reason = F.when((coherence < 0.3) & (n > 1), "low coherence").when((t < 15) & (n == 1), "too short").when((n > 0) & (t / F.when(n > 0, n) < 10) & c("section_header").isNull(), "sparse")
    return table(s, d, "chunks").select("chunk_id", "token_count", "sentence_count", "section_header", reason.alias("reason"))


@register("chunk_quality", f"WITH {QUALITY} SELECT chunk_id, reason FROM quality")
def chunk_quality(s, d):
    return _quality(s, d).select("chunk_id", "reason")


@register("discard_log", f"WITH {QUALITY} SELECT chunk_id, reason, token_count FROM quality WHERE reason IS NOT NULL")
def discard_log(s, d):
    return _quality(s, d).where("reason IS NOT NULL").select("chunk_id", "reason", "token_count")


@register("chunk_report", f"WITH {QUALITY} SELECT coalesce(reason, 'kept') AS outcome, count(*) AS n, round(100.0 * CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM quality), 4) AS pct FROM quality GROUP BY 1")
def chunk_report(s, d):
    counts = _quality(s, d).groupBy(F.coalesce("reason", F.lit("kept")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("pct", F.round(100.0 * c("n") / F.sum("n").over(Window.partitionBy()), 4))


@register("chunk_positions", f"WITH {QUALITY} SELECT q.chunk_id AS chunk_id, CAST(row_number() OVER (PARTITION BY string_split(q.chunk_id, '_CHUNK_')[1] ORDER BY q.chunk_id) - 1 AS INTEGER) AS place FROM (SELECT DISTINCT chunk_id FROM quality WHERE reason IS NULL) q")
def chunk_positions(s, d):
    kept = _quality(s, d).where("reason IS NULL").select("chunk_id").distinct()
    w = Window.partitionBy(F.element_at(F.split("chunk_id", "_CHUNK_"), 1)).orderBy("chunk_id")
    return kept.select("chunk_id", (F.row_number().over(w) - 1).alias("place"))


@register("explode_mentions", "SELECT chunk_id, unnest(chunk_ids) AS source_id FROM chunks")
def explode_mentions(s, d):
    return table(s, d, "chunks").select("chunk_id", F.explode("chunk_ids").alias("source_id"))


@register("chunk_id_fanout", "SELECT DISTINCT unnest(coalesce(chunk_ids, [chunk_id])) AS source_id, md5(text) AS digest FROM chunks WHERE text IS NOT NULL")
def chunk_id_fanout(s, d):
    return table(s, d, "chunks").where("text IS NOT NULL").select(F.explode(F.coalesce("chunk_ids", F.array("chunk_id"))).alias("source_id"), F.md5("text").alias("digest")).distinct()


@register("dup_docs_topk", "SELECT md5(text) AS digest, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1 ORDER BY n DESC, digest LIMIT 10")
def dup_docs_topk(s, d):
    return table(s, d, "documents").where("text IS NOT NULL").groupBy(F.md5("text").alias("digest")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy(F.desc("n"), "digest").limit(10)


LANGUAGE = "list_sort([" + ", ".join(f"{{'n': len(list_filter(regexp_split_to_array(lower(text[1:5000]), '[^a-zà-ÿ]+'), lambda w: w IN ({', '.join(q(w) for w in stop)}))), 'code': {q(code)}}}" for code, stop in V.STOP_WORDS.items()) + "])[-1]"


@register("detect_language", f"SELECT doc_id, CASE WHEN length(text) < 20 OR {LANGUAGE}.n = 0 THEN 'unknown' ELSE {LANGUAGE}.code END AS lang FROM documents WHERE text IS NOT NULL")
def detect_language(s, d):
    return table(s, d, "documents").where("text IS NOT NULL").select("doc_id", X.language(c("text")).alias("lang"))


@register("fix_encoding")
def fix_encoding(s, d):
    from tesselar.functions.encoding import fix_encoding

    return fix_encoding(raw(s, d).select("doc_id", "text")).select("doc_id", "encoding_fixes", F.length("text").alias("length"))


@register("strip_sections_report", "SELECT source_type, count(*) AS n, count(*) FILTER (WHERE text IS NULL) AS missing, count(*) FILTER (WHERE trim(text) = '') AS blank FROM raw_documents GROUP BY source_type")
def strip_sections_report(s, d):
    return table(s, d, "raw_documents").groupBy("source_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(c("text").isNull()).alias("missing"), F.count_if(F.trim("text") == "").alias("blank"))
