"""Entity filtering, resolution, relations and similarity."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tesselar.functions import text as X
from tesselar.functions import values as V
from tesselar.operators import graph as G
from tesselar.operators import linkage as L
from tesselar.operators import relations as R
from tesselar.operators import resolve as E
from tesselar.operators import similarity as S
from tesselar.plans.registry import register
from tesselar.plans.text_queries import q
from tesselar.session import bounded, table

c = F.col


def any_sql(text: str, patterns: list[str], any_case: bool = False) -> str:
    return f"regexp_matches({text}, {q(('(?i)' if any_case else '') + '|'.join('(?:' + p + ')' for p in patterns))})"


GARBAGE = f"""(trim(coalesce(name, '')) = '' OR {any_sql("coalesce(name, '')", V.GARBAGE)} OR {any_sql("coalesce(name, '')", V.GARBAGE_ANY_CASE, True)} OR (coalesce(type, '') <> 'Citation' AND {any_sql("coalesce(name, '')", V.GARBAGE_NUMBERS)})
 OR (coalesce(type, '') = 'Document' AND ({any_sql("coalesce(name, '')", V.GARBAGE_DOCUMENTS)} OR {any_sql("coalesce(name, '')", V.GARBAGE_DOCUMENTS_ANY_CASE, True)})) OR (coalesce(type, '') = 'DocumentSection' AND {any_sql("coalesce(name, '')", V.GARBAGE_SECTIONS)}))"""
MENTIONS = "m AS (SELECT pre_id, name, type, description, chunk_id FROM pre_entities GROUP BY ALL)"
WORDS = lambda t: f"list_distinct(list_filter(regexp_split_to_array(lower({t}), '[^a-z0-9]+'), lambda w: w <> ''))"
PROVENANCE = f"""{MENTIONS}, t AS (SELECT chunk_id, min(text) AS chunk_text FROM chunks WHERE text IS NOT NULL GROUP BY chunk_id),
 p AS (SELECT m.*, CASE WHEN chunk_text IS NULL OR chunk_text = '' OR contains(lower(chunk_text), lower(name)) THEN 1.0::DOUBLE WHEN len({WORDS('name')}) = 0 THEN 0.0 ELSE len(list_intersect({WORDS('name')}, {WORDS('chunk_text')}))::DOUBLE / len({WORDS('name')}) END AS score FROM m LEFT JOIN t USING (chunk_id))"""


def mentions(s, d):
    """Mentions, those delivered again once."""
    return table(s, d, "pre_entities").select("pre_id", "name", "type", "description", "chunk_id").distinct()


@register("garbage_filter", f"WITH {MENTIONS} SELECT pre_id, name, type FROM m WHERE NOT {GARBAGE}")
def garbage_filter(s, d):
    return mentions(s, d).where(~X.garbage_name(c("name"), c("type"))).select("pre_id", "name", "type")


@register("provenance_check", f"WITH {PROVENANCE} SELECT pre_id, round(score, 6) AS score, score >= 0.8 AS in_source FROM p WHERE name IS NOT NULL")
def provenance_check(s, d):
    return E.provenance(mentions(s, d).where("name IS NOT NULL"), table(s, d, "chunks")).select("pre_id", F.round("score", 6).alias("score"), "in_source")


@register("fuzzy_provenance")
def fuzzy_provenance(s, d):
    kept = mentions(s, d).where(~X.garbage_name(c("name"), c("type")))
    names = kept.select("name", "chunk_id").distinct()
    return E.fuzzy_provenance(names, table(s, d, "chunks"))


FILTERED = f"WITH {PROVENANCE}, f AS (SELECT *, CASE WHEN {GARBAGE} THEN 'garbage' WHEN score < 0.8 THEN 'not in source' END AS reason FROM p) "


@register("filter_with_reasons", FILTERED + "SELECT type, count(*) AS n, count(*) FILTER (WHERE reason = 'garbage') AS garbage, count(*) FILTER (WHERE reason = 'not in source') AS unsupported, count(*) FILTER (WHERE reason IS NULL) AS kept FROM f GROUP BY type")
def filter_with_reasons(s, d):
    f = E.filtered(mentions(s, d), table(s, d, "chunks"))
    return f.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.count_if(c("reason") == "garbage").alias("garbage"), F.count_if(c("reason") == "not in source").alias("unsupported"), F.count_if(c("reason").isNull()).alias("kept"))


def _in(values: list[str]) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


@register("route_by_type", f"SELECT pre_id, CASE WHEN type IN {_in(V.METADATA_TYPES)} THEN 'metadata' ELSE 'semantic' END AS track FROM pre_entities")
def route_by_type(s, d):
    return table(s, d, "pre_entities").select("pre_id", E.route(c("type")).alias("track"))


@register("strategy_class", f"SELECT DISTINCT type, CASE WHEN type IN {_in(V.SEMANTIC_TYPES)} THEN 'semantic' WHEN type IN {_in(V.ACADEMIC_TYPES)} THEN 'academic' ELSE 'skip' END AS strategy FROM pre_entities")
def strategy_class(s, d):
    return table(s, d, "pre_entities").select("type", E.strategy(c("type")).alias("strategy")).distinct()


@register("validate_entities", f"SELECT DISTINCT trim(name) AS name, trim(type) AS type, trim(name) || '(' || trim(type) || ')' AS embedding_text FROM pre_entities WHERE trim(name) <> '' AND trim(type) IN {_in(V.SEMANTIC_TYPES + V.METADATA_TYPES)}")
def validate_entities(s, d):
    t = table(s, d, "pre_entities").select(F.trim("name").alias("name"), F.trim("type").alias("type")).where((c("name") != "") & c("type").isin(V.SEMANTIC_TYPES + V.METADATA_TYPES))
    return t.distinct().withColumn("embedding_text", F.concat("name", F.lit("("), "type", F.lit(")")))


NORMAL = r"trim(lower(regexp_replace(name, '\s+', ' ', 'g')))"
CLEAN = f"{MENTIONS}, k AS (SELECT *, {NORMAL} AS g FROM m WHERE NOT {GARBAGE})"


def clean(s, d):
    return mentions(s, d).where(~X.garbage_name(c("name"), c("type")))


@register("exact_dedup", f"WITH {CLEAN} SELECT g AS normal, count(*) AS n, count(DISTINCT name) AS spellings, count(DISTINCT type) AS types FROM k GROUP BY g")
def exact_dedup(s, d):
    return clean(s, d).groupBy(X.normal_name(c("name")).alias("normal")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("name").alias("spellings"), F.countDistinct("type").alias("types"))


MERGED = f"""WITH {CLEAN}, nc AS (SELECT g, name, count(*) AS n, min(pre_id) AS f FROM k GROUP BY g, name), nb AS (SELECT g, arg_max(name, (n, -f)) AS name FROM nc GROUP BY g),
 tc AS (SELECT g, type, count(*) AS n, min(pre_id) AS f FROM k GROUP BY g, type), tb AS (SELECT g, arg_max(coalesce(type, '∅'), (n, -f)) AS type FROM tc GROUP BY g),
 r AS (SELECT g, count(*) AS merge_count, coalesce(len(list(DISTINCT chunk_id) FILTER (WHERE chunk_id IS NOT NULL)), 0) AS chunks, list(DISTINCT name) AS spellings, max(length(coalesce(description, ''))) AS described FROM k GROUP BY g) """


@register("merge_group", MERGED + "SELECT g, nb.name AS name, nullif(tb.type, '∅') AS type, CAST(described AS INTEGER) AS described, CAST(chunks AS INTEGER) AS chunks, list_sort(list_filter(spellings, lambda x: lower(x) <> lower(nb.name))) AS aliases, merge_count FROM r JOIN nb USING (g) JOIN tb USING (g)")
def merge_group(s, d):
    m = E.merge_groups(clean(s, d), X.normal_name(c("name")), "pre_id")
    return m.select("g", "name", "type", F.length(F.coalesce("description", F.lit(""))).alias("described"), F.size("chunk_ids").alias("chunks"), "aliases", "merge_count")


@register("dedup_stats", f"WITH {CLEAN}, a AS (SELECT g, count(*) AS n, count(DISTINCT type) AS t FROM k GROUP BY g) SELECT CAST(sum(n) AS BIGINT) AS before, count(*) AS after, max(n) AS largest, count(*) FILTER (WHERE t > 1) AS types_settled FROM a")
def dedup_stats(s, d):
    a = clean(s, d).groupBy(X.normal_name(c("name")).alias("g")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("type").alias("t"))
    return a.agg(F.sum("n").alias("before"), F.count(F.lit(1)).alias("after"), F.max("n").alias("largest"), F.count_if(c("t") > 1).alias("types_settled"))


@register("quality_flags", "SELECT count(*) FILTER (WHERE length(name) > 100) AS long, count(*) FILTER (WHERE regexp_matches(name, '[\\[\\](){}]')) AS brackets, count(*) FILTER (WHERE length(name) < 3) AS short, count(*) FILTER (WHERE regexp_matches(name, '^[0-9]+$')) AS numeric, count(*) FILTER (WHERE name IS NULL OR trim(name) = '') AS empty FROM pre_entities")
def quality_flags(s, d):
    n = c("name")
    return table(s, d, "pre_entities").agg(F.count_if(F.length(n) > 100).alias("long"), F.count_if(n.rlike(r"[\[\](){}]")).alias("brackets"), F.count_if(F.length(n) < 3).alias("short"), F.count_if(n.rlike("^[0-9]+$")).alias("numeric"), F.count_if(n.isNull() | (F.trim(n) == "")).alias("empty"))


@register("part_of", f"WITH {MENTIONS} SELECT DISTINCT a.name AS section, b.name AS document FROM m a JOIN m b ON a.chunk_id = b.chunk_id WHERE a.type IN ('Regulation', 'DocumentSection') AND b.type IN ('Regulation', 'Document') AND lower(a.name) <> lower(b.name) AND length(b.name) >= 5 AND length(b.name) < length(a.name) AND contains(lower(a.name), lower(b.name))")
def part_of(s, d):
    m = mentions(s, d)
    a, b = m.where("type IN ('Regulation', 'DocumentSection')").select(c("name").alias("section"), "chunk_id"), m.where("type IN ('Regulation', 'Document')").select(c("name").alias("document"), "chunk_id")
    ok = (F.lower("section") != F.lower("document")) & (F.length("document") >= 5) & (F.length("document") < F.length("section")) & F.contains(F.lower("section"), F.lower("document"))
    return a.join(b, "chunk_id").where(ok).select("section", "document").distinct()


@register("same_as_reg", f"WITH {MENTIONS}, r AS (SELECT trim(lower(name)) AS k, min(pre_id) AS reg FROM m WHERE type = 'Regulation' GROUP BY 1) SELECT DISTINCT name AS document, reg FROM m JOIN r ON trim(lower(name)) = k WHERE type = 'Document'")
def same_as_reg(s, d):
    m = mentions(s, d)
    r = m.where("type = 'Regulation'").groupBy(F.trim(F.lower("name")).alias("k")).agg(F.min("pre_id").alias("reg"))
    return m.where("type = 'Document'").join(r, F.trim(F.lower("name")) == c("k")).select(c("name").alias("document"), "reg").distinct()


@register("same_as_reg_fuzzy")
def same_as_reg_fuzzy(s, d):
    """Documents with the first regulation of an equal name or a ratio of 0.85; ``same_as_reg`` is the exact half, which its SQL checks."""
    m = mentions(s, d)
    name = F.trim(F.lower("name")).alias("title")
    reg = m.where("type = 'Regulation'").select(c("pre_id").alias("id"), name)
    return L.best_ratio(m.where("type = 'Document'").select(c("name").alias("id"), name).distinct(), reg, [], 0.85, parts=4, first=True).select(c("id").alias("document"), c("other").alias("reg"), c("score").alias("confidence"))


# ---- relations -------------------------------------------------------------

LINKED = "e AS (SELECT entity_id, name, type, unnest(chunk_ids) AS chunk_id FROM entities), cm AS (SELECT DISTINCT c.entity_id AS entity_id, c.name AS name, c.type AS type, p.chunk_id AS chunk_id FROM concepts c JOIN pre_entities p ON lower(p.name) = lower(c.name)), em AS (SELECT DISTINCT entity_id, type, chunk_id, false AS is_concept FROM e UNION SELECT entity_id, type, chunk_id, true FROM cm)"


def entity_mentions(s, d):
    """(entity_id, type, chunk_id, is_concept) of entities and of concepts that mentions name."""
    e = table(s, d, "entities").select("entity_id", "type", F.explode("chunk_ids").alias("chunk_id"), F.lit(False).alias("is_concept"))
    p = table(s, d, "pre_entities").where("name IS NOT NULL").select(F.lower("name").alias("k"), "chunk_id").distinct()
    k = table(s, d, "concepts").select("entity_id", "type", F.lower("name").alias("k")).join(p, "k").select("entity_id", "type", "chunk_id", F.lit(True).alias("is_concept"))
    return e.unionByName(k).distinct()


@register("cooccurrence", f"WITH {LINKED} SELECT chunk_id, list_sort(list(DISTINCT entity_id)) AS entities, coalesce(list_sort(list(DISTINCT entity_id) FILTER (WHERE is_concept)), []) AS concepts FROM em GROUP BY chunk_id")
def cooccurrence(s, d):
    return R.cooccurrence(entity_mentions(s, d))


@register("chunk_entity_map", f"WITH {LINKED} SELECT entity_id, count(DISTINCT chunk_id) AS chunks FROM em GROUP BY entity_id")
def chunk_entity_map(s, d):
    return entity_mentions(s, d).groupBy("entity_id").agg(F.countDistinct("chunk_id").alias("chunks"))


PAIRS = f"WITH {LINKED}, rel AS (SELECT DISTINCT a.entity_id AS subject, lower(replace(b.type, 'Concept', '')) AS predicate, b.entity_id AS object FROM em a JOIN em b ON a.chunk_id = b.chunk_id WHERE NOT a.is_concept AND b.is_concept) "


def concept_relations(s, d):
    """(subject, predicate, object, chunk_id) from entities to concepts of the same chunk."""
    m = entity_mentions(s, d)
    a, b = m.where("NOT is_concept").select(c("entity_id").alias("subject"), "chunk_id"), m.where("is_concept").select(c("entity_id").alias("object"), F.lower(F.replace("type", F.lit("Concept"), F.lit(""))).alias("predicate"), "chunk_id")
    return a.join(b, "chunk_id").select("subject", "predicate", "object", "chunk_id").distinct()


@register("relation_dedup", f"WITH {LINKED}, rel AS (SELECT DISTINCT a.entity_id AS subject, lower(replace(b.type, 'Concept', '')) AS predicate, b.entity_id AS object, a.chunk_id AS chunk_id FROM em a JOIN em b ON a.chunk_id = b.chunk_id WHERE NOT a.is_concept AND b.is_concept) SELECT subject, predicate, object, list_sort(list(DISTINCT chunk_id)) AS chunk_ids FROM rel GROUP BY 1, 2, 3")
def relation_dedup(s, d):
    return R.deduplicated(concept_relations(s, d).select("subject", "predicate", "object", F.array("chunk_id").alias("chunk_ids")))


CLAIMED = f"WITH {LINKED}, claimed AS (SELECT DISTINCT a.entity_id AS subject, k.entity_id AS object FROM entities a JOIN concepts k ON substring(a.entity_id, 5, 1) = substring(k.entity_id, 5, 1)) "


@register("validate_cooccurrence", CLAIMED + "SELECT subject, object, CASE WHEN subject NOT IN (SELECT entity_id FROM em) THEN 'subject_not_found' WHEN object NOT IN (SELECT entity_id FROM em) THEN 'object_not_found' WHEN (subject, object) NOT IN (SELECT (x.entity_id, y.entity_id) FROM em x JOIN em y ON x.chunk_id = y.chunk_id) THEN 'no_cooccurrence' ELSE 'valid' END AS reason FROM claimed")
def validate_cooccurrence(s, d):
    a, k = table(s, d, "entities").select(c("entity_id").alias("subject")), table(s, d, "concepts").select(c("entity_id").alias("object"))
    claimed = a.join(bounded(k), F.substring("subject", 5, 1) == F.substring("object", 5, 1)).distinct()  # the 140 concepts are a fixed table
    return R.validated(claimed, entity_mentions(s, d)).select("subject", "object", "reason")


@register("relation_validate_ids", PAIRS + "SELECT subject, predicate, object FROM rel WHERE subject <> object AND object IN (SELECT entity_id FROM concepts) AND predicate <> ''")
def relation_validate_ids(s, d):
    r = concept_relations(s, d).select("subject", "predicate", "object").distinct()
    return r.where((c("subject") != c("object")) & (c("predicate") != "")).join(table(s, d, "concepts").select(c("entity_id").alias("object")), "object", "left_semi").select("subject", "predicate", "object")


@register("citation_concept_chunks", f"WITH {LINKED} SELECT chunk_id, count(DISTINCT entity_id) FILTER (WHERE type IN ('Author', 'Journal')) AS academic, count(DISTINCT entity_id) FILTER (WHERE is_concept) AS concepts FROM em GROUP BY chunk_id HAVING academic > 0 AND concepts > 0")
def citation_concept_chunks(s, d):
    g = entity_mentions(s, d).groupBy("chunk_id").agg(F.countDistinct(F.when(c("type").isin("Author", "Journal"), c("entity_id"))).alias("academic"), F.countDistinct(F.when(c("is_concept"), c("entity_id"))).alias("concepts"))
    return g.where("academic > 0 AND concepts > 0")


@register("matchable", PAIRS + "SELECT DISTINCT entity_id FROM entities WHERE type IN ('Author', 'Journal') OR (type IN ('Organization', 'Regulation') AND entity_id IN (SELECT subject FROM rel))")
def matchable(s, d):
    e = table(s, d, "entities")
    r = concept_relations(s, d).select(c("subject").alias("entity_id")).distinct()
    return e.where("type IN ('Author', 'Journal')").select("entity_id").unionByName(e.where("type IN ('Organization', 'Regulation')").join(r, "entity_id", "left_semi").select("entity_id")).distinct()


@register("detected_entities", f"WITH {LINKED}, k AS (SELECT type, entity_id, count(*) AS n FROM em GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY n DESC, entity_id) AS place FROM k) SELECT type, entity_id, n, CAST(place AS INTEGER) AS place FROM r WHERE place <= 25")
def detected_entities(s, d):
    k = entity_mentions(s, d).groupBy("type", "entity_id").agg(F.count(F.lit(1)).alias("n"))
    return k.withColumn("place", F.row_number().over(Window.partitionBy("type").orderBy(F.desc("n"), "entity_id"))).where("place <= 25")


@register("alias_report", "SELECT type, count(*) AS entities, CAST(sum(len(coalesce(aliases, []))) AS BIGINT) AS aliases, CAST(max(len(coalesce(aliases, []))) AS INTEGER) AS most FROM entities GROUP BY type")
def alias_report(s, d):
    n = F.size(F.coalesce("aliases", F.array().cast("array<string>")))
    return table(s, d, "entities").groupBy("type").agg(F.count(F.lit(1)).alias("entities"), F.sum(n).alias("aliases"), F.max(n).alias("most"))


@register("entity_union_first", "WITH u AS (SELECT entity_id, name, 1 AS track FROM entities UNION ALL SELECT entity_id, name, 2 FROM concepts) SELECT entity_id, arg_min(name, track) AS name FROM u GROUP BY entity_id")
def entity_union_first(s, d):
    u = table(s, d, "entities").select("entity_id", "name", F.lit(1).alias("track")).unionByName(table(s, d, "concepts").select("entity_id", "name", F.lit(2).alias("track")))
    return E.first_of(u, ["entity_id"], c("track")).select("entity_id", "name")


@register("budget_prefix", "WITH t AS (SELECT string_split(chunk_id, '_CHUNK_')[1] AS doc, chunk_id, max(coalesce(token_count, 0)) AS cost FROM chunks GROUP BY 1, 2), r AS (SELECT *, sum(cost) OVER (PARTITION BY doc ORDER BY chunk_id ROWS UNBOUNDED PRECEDING) AS spent FROM t) SELECT doc, chunk_id, CAST(spent AS BIGINT) AS spent FROM r WHERE spent <= 500")
def budget_prefix(s, d):
    return R.budgeted(_costs(s, d), ["doc"], [c("chunk_id")], c("cost"), 500).select("doc", "chunk_id", "spent")


def _costs(s, d):
    t = table(s, d, "chunks")
    return t.groupBy(F.element_at(F.split("chunk_id", "_CHUNK_"), 1).alias("doc"), "chunk_id").agg(F.max(F.coalesce("token_count", F.lit(0))).alias("cost"))


@register("fit_context", "WITH t AS (SELECT string_split(chunk_id, '_CHUNK_')[1] AS doc, chunk_id, max(coalesce(token_count, 0)) AS cost FROM chunks GROUP BY 1, 2), r AS (SELECT *, CAST(sum(cost) OVER (PARTITION BY doc ORDER BY chunk_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS spent FROM t) SELECT doc, chunk_id, CAST(CASE WHEN spent <= 500 THEN cost ELSE 500 - (spent - cost) END AS BIGINT) AS granted FROM r WHERE spent <= 500 OR 500 - (spent - cost) >= 50")
def fit_context(s, d):
    return R.fitted(_costs(s, d), ["doc"], [c("chunk_id")], c("cost"), 500, 50).select("doc", "chunk_id", c("granted").cast("bigint").alias("granted"))


# ---- vectors ---------------------------------------------------------------

VEC = "v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL), sim AS (SELECT x.vec_id AS a, y.vec_id AS b, list_inner_product(x.e, y.e) / sqrt(list_inner_product(x.e, x.e) * list_inner_product(y.e, y.e)) AS s FROM v x JOIN v y ON x.vec_id < y.vec_id)"


def vectors(s, d):
    return table(s, d, "embeddings")


@register("sim_selfjoin", f"WITH {VEC} SELECT a, b, round(s, 5) AS similarity FROM sim WHERE s >= 0.35")
def sim_selfjoin(s, d):
    return S.similar_pairs(vectors(s, d), 0.35, "vec_id", "embedding").select("a", "b", F.round("similarity", 5).alias("similarity"))


@register("knn_selfjoin", f"WITH {VEC}, w AS (SELECT a, b, s FROM sim WHERE s >= 0.3 UNION ALL SELECT b, a, s FROM sim WHERE s >= 0.3), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS rank FROM w) SELECT a AS id, b AS other, round(s, 5) AS similarity, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5")
def knn_selfjoin(s, d):
    return S.nearest_of_pairs(S.similar_pairs(vectors(s, d), 0.3, "vec_id", "embedding"), 5).withColumn("similarity", F.round("similarity", 5))


@register("dedup_first_wins", f"WITH {VEC} SELECT vec_id FROM v WHERE vec_id NOT IN (SELECT b FROM sim WHERE s >= 0.4)")
def dedup_first_wins(s, d):
    return S.drop_repeats(vectors(s, d).select("vec_id"), S.similar_pairs(vectors(s, d), 0.4, "vec_id", "embedding"), "vec_id")


@register("sim_bands", f"WITH {VEC} SELECT CAST(floor(s * 20) AS BIGINT) AS band, count(*) AS n FROM sim WHERE s >= 0.25 GROUP BY 1")
def sim_bands(s, d):
    return S.similar_pairs(vectors(s, d), 0.25, "vec_id", "embedding").groupBy(F.floor(c("similarity") * 20).alias("band")).agg(F.count(F.lit(1)).alias("n"))


@register("threshold_sweep", f"WITH {VEC} SELECT t AS threshold, count(*) FILTER (WHERE s >= t) AS pairs FROM sim, (SELECT unnest([0.25::DOUBLE, 0.3, 0.35, 0.4]) AS t) WHERE s >= 0.25 GROUP BY t")
def threshold_sweep(s, d):
    pairs = S.similar_pairs(vectors(s, d), 0.25, "vec_id", "embedding")
    hit = F.explode(F.filter(F.array(*(F.lit(t) for t in (0.25, 0.3, 0.35, 0.4))), lambda t: c("similarity") >= t)).alias("threshold")
    return pairs.select(hit).groupBy("threshold").agg(F.count(F.lit(1)).alias("pairs"))


@register("tiered_threshold", f"WITH {VEC} SELECT CASE WHEN s >= 0.4 THEN 'merge' WHEN s < 0.3 THEN 'reject' ELSE 'uncertain' END AS tier, count(*) AS n FROM sim WHERE s >= 0.25 GROUP BY 1")
def tiered_threshold(s, d):
    return S.similar_pairs(vectors(s, d), 0.25, "vec_id", "embedding").groupBy(E.tier(c("similarity"), 0.4, 0.3).alias("tier")).agg(F.count(F.lit(1)).alias("n"))


@register("pair_cap", f"WITH {VEC} SELECT a, b, round(s, 5) AS similarity FROM sim WHERE s >= 0.3 ORDER BY s DESC, a, b LIMIT 25")
def pair_cap(s, d):
    return S.similar_pairs(vectors(s, d), 0.3, "vec_id", "embedding").orderBy(F.desc("similarity"), "a", "b").limit(25).withColumn("similarity", F.round("similarity", 5))


@register("vector_table", "SELECT vec_id, CAST(len(embedding) AS INTEGER) AS dim, round(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 4) AS norm2 FROM embeddings WHERE embedding IS NOT NULL")
def vector_table(s, d):
    return vectors(s, d).where("embedding IS NOT NULL").select("vec_id", F.size("embedding").alias("dim"), F.round(S.dot(c("embedding"), c("embedding")), 4).alias("norm2"))


@register("band_sample", f"WITH {VEC}, k AS (SELECT a, b, CAST(floor(s * 20) AS BIGINT) AS band FROM sim WHERE s >= 0.25), r AS (SELECT *, row_number() OVER (PARTITION BY band ORDER BY a, b) AS place FROM k) SELECT band, a, b FROM r WHERE place <= 15")
def band_sample(s, d):
    k = S.similar_pairs(vectors(s, d), 0.25, "vec_id", "embedding").withColumn("band", F.floor(c("similarity") * 20))
    return k.withColumn("place", F.row_number().over(Window.partitionBy("band").orderBy("a", "b"))).where("place <= 15").select("band", "a", "b")


@register("coherence", "WITH o AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e, lag(CAST(embedding AS DOUBLE[])) OVER (PARTITION BY label ORDER BY vec_id) AS before FROM embeddings) SELECT label, round(coalesce(avg(list_inner_product(e, before) / sqrt(list_inner_product(e, e) * list_inner_product(before, before))) FILTER (WHERE before IS NOT NULL), 0), 5) AS coherence FROM o GROUP BY label")
def coherence(s, d):
    o = vectors(s, d).withColumn("before", F.lag("embedding").over(Window.partitionBy("label").orderBy("vec_id")))
    near = F.when(c("before").isNotNull(), S.cosine(c("embedding"), c("before")))
    return o.groupBy("label").agg(F.round(F.coalesce(F.avg(near), F.lit(0.0)), 5).alias("coherence"))


def _links(s, d):
    return S.similar_pairs(vectors(s, d), 0.35, "vec_id", "embedding")


@register("merge_near_dups", f"WITH RECURSIVE {VEC}, e AS (SELECT a, b FROM sim WHERE s >= 0.4 UNION SELECT b, a FROM sim WHERE s >= 0.4), reach(node, other) AS (SELECT a, b FROM e UNION SELECT r.node, e.b FROM reach r JOIN e ON r.other = e.a), g AS (SELECT node, least(node, min(other)) AS root FROM reach GROUP BY node) SELECT root, count(*) AS members FROM g GROUP BY root")
def merge_near_dups(s, d):
    pairs = S.similar_pairs(vectors(s, d), 0.4, "vec_id", "embedding")
    return G.components(pairs.select(c("a").alias("src"), c("b").alias("dst"))).groupBy(c("component").alias("root")).agg(F.count(F.lit(1)).alias("members"))


@register("capped_union")
def capped_union(s, d):
    pairs = _links(s, d).withColumn("ord", -F.round(c("similarity") * 1e9).cast("bigint"))
    return E.capped_union(pairs.select("a", "b", "ord"), 20)


@register("bridge_cut")
def bridge_cut(s, d):
    return E.bridge_cut(_links(s, d).where("similarity >= 0.38"))


def _candidates(s, d):
    v = vectors(s, d)
    near = S.nearest_of_pairs(S.similar_pairs(v, 0.2, "vec_id", "embedding"), 30)
    return near.join(v.select(c("vec_id").alias("other"), "embedding", "label"), "other").select(c("id").alias("query"), c("other").alias("id"), c("rank").alias("ord"), c("similarity").alias("relevance"), c("embedding").alias("vector"), F.array("label", (c("other") % 7).cast("int")).alias("members"))


@register("mmr_select")
def mmr_select(s, d):
    return R.select_diverse(_candidates(s, d), 6)


@register("coverage_select")
def coverage_select(s, d):
    return R.select_diverse(_candidates(s, d), 6, coverage=True)


@register("adaptive_rounds")
def adaptive_rounds(s, d):
    return R.adaptive(_candidates(s, d), 6)


EMBEDDED = "ev AS (SELECT DISTINCT chunk_id, CAST(embedding AS DOUBLE[]) AS v FROM embedded_chunks WHERE len(embedding) = 64), ok AS (SELECT chunk_id, v FROM ev WHERE list_inner_product(v, v) > 0), es AS (SELECT x.chunk_id AS a, y.chunk_id AS b, list_inner_product(x.v, y.v) / sqrt(list_inner_product(x.v, x.v) * list_inner_product(y.v, y.v)) AS s FROM ok x JOIN ok y ON x.chunk_id < y.chunk_id)"


@register("candidate_chunks", f"WITH {EMBEDDED}, dir AS (SELECT DISTINCT name AS entity, chunk_id AS chunk FROM pre_entities WHERE name IS NOT NULL AND chunk_id IS NOT NULL), bw AS (SELECT a AS chunk, b AS other, s FROM es WHERE s >= 0.85 UNION ALL SELECT b, a, s FROM es WHERE s >= 0.85), near AS (SELECT entity, other AS chunk, max(s) AS s FROM dir JOIN bw USING (chunk) GROUP BY 1, 2), u AS (SELECT entity, chunk, 1.0::DOUBLE AS s, true AS direct FROM dir UNION ALL SELECT n.entity, n.chunk, n.s, false FROM near n ANTI JOIN dir ON n.entity = dir.entity AND n.chunk = dir.chunk), r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY direct DESC, round(s, 9) DESC, chunk) AS place FROM u) SELECT entity, chunk, direct FROM r WHERE place <= 200")
def candidate_chunks(s, d):
    """Of each name the chunks that mention it, then those like them (.85), 200 at most as the operator has it."""
    direct = table(s, d, "pre_entities").where("name IS NOT NULL AND chunk_id IS NOT NULL").select(c("name").alias("entity"), c("chunk_id").alias("chunk")).distinct()
    v = table(s, d, "embedded_chunks").where(F.size("embedding") == 64).select("chunk_id", "embedding").distinct()
    v = v.where(S.dot(c("embedding"), c("embedding")) > 0)
    p = S.similar_pairs(v, 0.85, "chunk_id", "embedding")
    both = p.select(c("a").alias("chunk"), c("b").alias("to"), "similarity").unionByName(p.select(c("b").alias("chunk"), c("a").alias("to"), "similarity"))
    near = direct.join(both, "chunk").groupBy("entity", c("to").alias("chunk")).agg(F.max("similarity").alias("s")).join(direct, ["entity", "chunk"], "left_anti")
    u = direct.select("entity", "chunk", F.lit(1.0).alias("s"), F.lit(True).alias("direct")).unionByName(near.select("entity", "chunk", "s", F.lit(False).alias("direct")))
    return u.withColumn("place", F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("direct"), F.desc(F.round("s", 9)), "chunk"))).where("place <= 200").select("entity", "chunk", "direct")
