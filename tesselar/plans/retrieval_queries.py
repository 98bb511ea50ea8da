"""Retrieval, ranking, expansion and evaluation over a stated set of query vectors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tesselar.operators import graph as G
from tesselar.operators import relations as R
from tesselar.operators import retrieval as T
from tesselar.operators import similarity as S
from tesselar.plans import graph_tables
from tesselar.plans.registry import register
from tesselar.session import bounded, table

c = F.col

# Queries are every fiftieth vector; chunks are all vectors, with a jurisdiction
# and a kind by their id; the graph finds the chunks of the query's label.
QUERIES = "q AS (SELECT vec_id AS query, label, CAST(embedding AS DOUBLE[]) AS qv FROM embeddings WHERE vec_id % 50 = 0)"
CHUNKS = "k AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v, 'J' || (vec_id % 7) AS jurisdiction, CASE WHEN vec_id % 2 = 0 THEN 'regulation' ELSE 'paper' END AS kind FROM embeddings)"
COS = "list_inner_product(qv, v) / sqrt(list_inner_product(qv, qv) * list_inner_product(v, v))"
SEM = f"{QUERIES}, {CHUNKS}, sr AS (SELECT query, id, {COS} AS score FROM q, k), sp AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS place FROM sr), sem AS (SELECT query, id, score, CAST(place AS INTEGER) AS rank FROM sp WHERE place <= 15)"
GR = "gr AS (SELECT query, id, CAST(least(0.40 + 0.05 * (id % 6), 0.60) AS DOUBLE) AS score, id % 4 = 0 AS provenance FROM q JOIN k ON q.label = k.label)"
MERGE = f"{SEM}, {GR}, mg AS (SELECT query, id, CASE WHEN sem.score IS NOT NULL AND gr.score IS NOT NULL THEN 'dual' WHEN gr.score IS NOT NULL THEN 'graph' ELSE 'semantic' END AS found_by, sem.score AS s, gr.score AS g FROM sem FULL JOIN gr USING (query, id))"
PEN = "(CASE WHEN jurisdiction <> 'J' || (query % 7) THEN 0.9 ELSE 1.0 END) * (CASE WHEN kind <> 'regulation' THEN 0.85 ELSE 1.0 END)"


def queries(s, d):
    return table(s, d, "embeddings").where("vec_id % 50 = 0").select(c("vec_id").alias("query"), "label", c("embedding").alias("qv"))


def chunks(s, d):
    return table(s, d, "embeddings").select(c("vec_id").alias("id"), "label", c("embedding").alias("v"), F.concat(F.lit("J"), (c("vec_id") % 7).cast("string")).alias("jurisdiction"), F.when(c("vec_id") % 2 == 0, "regulation").otherwise("paper").alias("kind"))


def semantic(s, d):
    return S.search(queries(s, d), chunks(s, d), 15).select("query", "id", c("similarity").alias("score"), "rank")


def by_graph(s, d):
    j = queries(s, d).select("query", "label").join(chunks(s, d), "label")
    return j.select("query", "id", T.graph_score(c("id") % 6).cast("double").alias("score"), (c("id") % 4 == 0).alias("provenance"))


def merged(s, d):
    return T.merged_channels(semantic(s, d), by_graph(s, d))


def _penalty():
    return T.penalty(c("jurisdiction"), c("kind"), F.array(F.concat(F.lit("J"), (c("query") % 7).cast("string"))), F.array(F.lit("regulation")))


@register("semantic_chunks", f"WITH {SEM} SELECT query, id, round(score, 5) AS score, rank FROM sem")
def semantic_chunks(s, d):
    return semantic(s, d).withColumn("score", F.round("score", 5))


@register("graph_chunks", f"WITH {QUERIES}, {CHUNKS}, {GR} SELECT query, id, score, provenance FROM gr")
def graph_chunks(s, d):
    return by_graph(s, d)


@register("merge_channels", f"WITH {MERGE} SELECT query, id, found_by FROM mg")
def merge_channels(s, d):
    return merged(s, d).select("query", "id", "found_by")


@register("filter_penalty", f"WITH {MERGE} SELECT query, id, CAST(round({PEN}, 4) AS DOUBLE) AS factor FROM mg JOIN k USING (id)")
def filter_penalty(s, d):
    """The factor of every chunk that either channel found."""
    return merged(s, d).join(chunks(s, d).drop("v", "label"), "id").select("query", "id", F.round(_penalty(), 4).alias("factor"))


RANK = lambda score, src: f"SELECT query, id, round({score}, 5) AS score, CAST(row_number() OVER (PARTITION BY query ORDER BY round({score}, 5) DESC, id) AS INTEGER) AS place FROM {src} JOIN k USING (id) QUALIFY place <= 20"


@register("rank_semantic", f"WITH {SEM} " + RANK(f"score * {PEN}", "sem"))
def rank_semantic(s, d):
    j = semantic(s, d).join(chunks(s, d).drop("v", "label"), "id").withColumn("score", F.round(c("score") * _penalty(), 5))
    return T.top(j, 20).select("query", "id", "score", "place")


@register("rank_graph", f"WITH {QUERIES}, {CHUNKS}, {GR} " + RANK(f"least(((id % 3 = query % 3)::INTEGER + 0.5 * (id % 5 = 0)::INTEGER + CASE WHEN provenance THEN 0.1 ELSE 0.0 END) / 1.6, 1.0) * {PEN}", "gr"))
def rank_graph(s, d):
    j = by_graph(s, d).join(chunks(s, d).drop("v", "label"), "id")
    # a chunk's members: what is left of its id by 3, and the path's node 10 if 5 divides the id
    members = F.array(c("id") % 3, F.when(c("id") % 5 == 0, 10).otherwise(-1).cast("bigint"))
    score = T.graph_rank(F.array(c("query") % 3), F.array(F.lit(10).cast("bigint")), members, c("provenance"))
    return T.top(j.withColumn("score", F.round(score * _penalty(), 5)), 20).select("query", "id", "score", "place")


@register("rank_dual", f"WITH {MERGE} SELECT query, id, found_by, round(coalesce(s, 0.5) * {PEN} * CASE WHEN found_by = 'dual' THEN 1.05 ELSE 1.0 END, 5) AS score, CAST(row_number() OVER (PARTITION BY query ORDER BY round(coalesce(s, 0.5) * {PEN} * CASE WHEN found_by = 'dual' THEN 1.05 ELSE 1.0 END, 5) DESC, id) AS INTEGER) AS place FROM mg JOIN k USING (id) QUALIFY place <= 20")
def rank_dual(s, d):
    return ranked(s, d).select("query", "id", "found_by", "score", "place")


def ranked(s, d):
    j = merged(s, d).join(chunks(s, d).drop("v", "label"), "id")
    score = F.coalesce("semantic_score", F.lit(0.5)) * _penalty() * F.when(c("found_by") == "dual", 1.05).otherwise(1.0)
    return T.top(j.withColumn("score", F.round(score, 5)), 20)


DUAL = f"WITH {MERGE}, rk AS (SELECT query, id, found_by, kind, jurisdiction, round(coalesce(s, 0.5) * {PEN} * CASE WHEN found_by = 'dual' THEN 1.05 ELSE 1.0 END, 5) AS score FROM mg JOIN k USING (id)), t20 AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS INTEGER) AS place FROM rk QUALIFY place <= 20) "


@register("retrieval_metrics", DUAL + "SELECT query, count(*) AS n, count(*) FILTER (WHERE found_by = 'dual') AS dual, count(*) FILTER (WHERE found_by = 'graph') AS graph, count(*) FILTER (WHERE found_by = 'semantic') AS semantic, round(avg(score), 7) AS mean_score, count(*) FILTER (WHERE kind = 'regulation') AS regulations, count(DISTINCT jurisdiction) AS jurisdictions FROM t20 GROUP BY query")
def retrieval_metrics(s, d):
    f = lambda v: F.count_if(c("found_by") == v).alias(v)
    return ranked(s, d).groupBy("query").agg(F.count(F.lit(1)).alias("n"), f("dual"), f("graph"), f("semantic"), F.round(F.avg("score"), 7).alias("mean_score"), F.count_if(c("kind") == "regulation").alias("regulations"), F.countDistinct("jurisdiction").alias("jurisdictions"))


@register("assemble_prompt", DUAL + ", c AS (SELECT query, id, place, 60 + id % 90 AS cost FROM t20), b AS (SELECT *, sum(cost) OVER (PARTITION BY query ORDER BY place ROWS UNBOUNDED PRECEDING) AS spent FROM c) SELECT query, string_agg('[' || place || '] ' || id, ' ' ORDER BY place) AS prompt FROM b WHERE spent <= 1000 GROUP BY query")
def assemble_prompt(s, d):
    rows = ranked(s, d).withColumn("cost", F.lit(60) + c("id") % 90)
    fit = R.budgeted(rows, ["query"], [c("place")], c("cost"), 1000)
    line = F.struct("place", F.concat(F.lit("["), c("place").cast("string"), F.lit("] "), c("id").cast("string")).alias("t"))
    return fit.groupBy("query").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["t"]), " ").alias("prompt"))


@register("cost_estimate", "SELECT CAST(sum(1500.0 * 1.35 * n) AS DOUBLE) AS tokens, round(CAST(sum(1500.0 * 1.35 * n) AS DOUBLE) * 0.2 / 1e6, 6) AS dollars FROM (SELECT count(*) AS n FROM entities GROUP BY type)")
def cost_estimate(s, d):
    n = table(s, d, "entities").groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.sum(F.lit(1500.0) * 1.35 * c("n")).alias("tokens")).select("tokens", F.round(c("tokens") * 0.2 / 1e6, 6).alias("dollars"))


@register("result_record", DUAL + "SELECT query, CAST(count(*) AS INTEGER) AS chunks, CAST(min(id) FILTER (WHERE place = 1) AS BIGINT) AS first FROM t20 GROUP BY query")
def result_record(s, d):
    return ranked(s, d).groupBy("query").agg(F.count(F.lit(1)).cast("int").alias("chunks"), F.min(F.when(c("place") == 1, c("id"))).alias("first"))


MODES = DUAL + ", ms AS (SELECT query, coalesce(avg(score) FILTER (WHERE found_by = 'semantic'), 0) AS semantic, coalesce(avg(score) FILTER (WHERE found_by = 'graph'), 0) AS graph, coalesce(avg(score) FILTER (WHERE found_by = 'dual'), 0) AS dual FROM t20 GROUP BY query) "


def modes(s, d):
    f = lambda v: F.coalesce(F.avg(F.when(c("found_by") == v, c("score"))), F.lit(0.0)).alias(v)
    return ranked(s, d).groupBy("query").agg(f("semantic"), f("graph"), f("dual"))


@register("mode_winners", MODES + "SELECT query, CASE WHEN greatest(semantic, graph, dual) = 0 THEN 'N/A' WHEN semantic = graph AND graph = dual THEN 'tie' WHEN semantic = greatest(semantic, graph, dual) THEN 'semantic' WHEN graph = greatest(semantic, graph, dual) THEN 'graph' ELSE 'dual' END AS winner FROM ms")
def mode_winners(s, d):
    return T.winners(modes(s, d))


@register("mode_summary", MODES + "SELECT round(avg(semantic), 4) AS semantic, round(avg(graph), 4) AS graph, round(avg(dual), 4) AS dual, count(*) AS n FROM ms")
def mode_summary(s, d):
    return modes(s, d).agg(F.round(F.avg("semantic"), 4).alias("semantic"), F.round(F.avg("graph"), 4).alias("graph"), F.round(F.avg("dual"), 4).alias("dual"), F.count(F.lit(1)).alias("n"))


@register("report_tables", MODES + "SELECT mode, round(avg(score), 4) AS mean FROM (SELECT query, unnest(['semantic', 'graph', 'dual']) AS mode, unnest([semantic, graph, dual]) AS score FROM ms) GROUP BY mode")
def report_tables(s, d):
    return modes(s, d).unpivot(["query"], ["semantic", "graph", "dual"], "mode", "score").groupBy("mode").agg(F.round(F.avg("score"), 4).alias("mean"))


@register("coverage_metrics", "WITH a AS (SELECT item_id AS query, text AS answer FROM eval_items), t AS (SELECT name AS term FROM concepts UNION SELECT unnest(['contact_person', 'paper_fallback', 'input_records'])), h AS (SELECT query, contains(lower(answer), lower(replace(term, '_', ' '))) AS hit FROM a, t) SELECT query, count(*) AS terms, count(*) FILTER (WHERE hit) AS covered, round(count(*) FILTER (WHERE hit)::DOUBLE / count(*), 6) AS rate FROM h GROUP BY query")
def coverage_metrics(s, d):
    answers = table(s, d, "eval_items").select(c("item_id").alias("query"), c("text").alias("answer"))
    extra = s.createDataFrame([("contact_person",), ("paper_fallback",), ("input_records",)], "term string")
    terms = table(s, d, "concepts").select(c("name").alias("term")).union(extra).distinct()
    # both tables are fixed: 120 answers, 143 terms
    return T.coverage(answers, answers.select("query").join(bounded(terms)))


@register("graph_util", graph_tables.GRAPH + "SELECT predicate, count(DISTINCT src) AS subjects, count(DISTINCT dst) AS objects, count(*) AS n FROM relations GROUP BY predicate")
def graph_util(s, d):
    return graph_tables.relations(s, d).groupBy("predicate").agg(F.countDistinct("src").alias("subjects"), F.countDistinct("dst").alias("objects"), F.count(F.lit(1)).alias("n"))


@register("resolve_fuzzy", f"WITH {QUERIES}, {CHUNKS}, r AS (SELECT query, id, {COS} AS score FROM q, k), p AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM r) SELECT query, id, round(score, 5) AS score FROM p WHERE rank <= 10 AND score >= 0.35")
def resolve_fuzzy(s, d):
    return S.search(queries(s, d), chunks(s, d), 10).where("similarity >= 0.35").select("query", "id", F.round("similarity", 5).alias("score"))


def _nearest(s, d):
    return S.nearest_of_pairs(S.similar_pairs(table(s, d, "embeddings"), 0.25, "vec_id", "embedding"), 5)


def _terminals(s, d):
    return queries(s, d).select("query", c("query").alias("id"))


@register("single_expand", f"WITH {QUERIES}, {CHUNKS}, r AS (SELECT query, id, {COS} AS score FROM q, k WHERE query <> id), p AS (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM r WHERE score >= 0.25) SELECT query, id FROM p WHERE rank <= 5 UNION ALL SELECT query, query FROM q")
def single_expand(s, d):
    return T.expand_nearest(_terminals(s, d), _nearest(s, d), 5, 50).select("query", "id")


NEAREST = "cs AS (SELECT x.id AS id, y.id AS other, list_inner_product(x.v, y.v) / sqrt(list_inner_product(x.v, x.v) * list_inner_product(y.v, y.v)) AS s FROM k x JOIN k y ON x.id <> y.id), nr AS (SELECT id, other, CAST(row_number() OVER (PARTITION BY id ORDER BY s DESC, other) AS INTEGER) AS rank FROM cs WHERE s >= 0.25)"


@register("spine_expand", f"WITH {QUERIES}, {CHUNKS}, {NEAREST}, s1 AS (SELECT query, query AS id FROM q UNION SELECT query, other FROM q JOIN nr ON nr.id = query AND rank <= 2), s2 AS (SELECT query, id, 0 AS step FROM s1 UNION ALL SELECT query, other, rank FROM s1 JOIN nr USING (id) WHERE rank <= 3) SELECT query, id, CAST(min(step) AS INTEGER) AS step FROM s2 GROUP BY query, id")
def spine_expand(s, d):
    spine = T.expand_nearest(_terminals(s, d), _nearest(s, d), 2, 50).select("query", "id")
    return T.expand_nearest(spine, _nearest(s, d), 3, 50)


@register("steiner_expand")
def steiner_expand(s, d):
    e = graph_tables.relations(s, d)
    sup = e.where("src LIKE 's%'").select(c("src").alias("id")).distinct().withColumn("query", F.pmod(F.xxhash64("id"), F.lit(4)).cast("int"))
    few = sup.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy("id"))).where("r <= 3").select("query", "id")
    return T.steiner(few, e)


@register("expand_metrics")
def expand_metrics(s, d):
    out = steiner_expand(s, d)
    inside = G.induced(graph_tables.relations(s, d), out.select("id").distinct())
    return out.groupBy("query").agg(F.count(F.lit(1)).alias("nodes")).crossJoin(inside.agg(F.count(F.lit(1)).alias("relations")))


@register("retrieve_modes", DUAL + "SELECT query, id, round(score, 5) AS score, 'semantic' AS mode FROM sem UNION ALL SELECT query, id, score, 'graph' FROM gr UNION ALL SELECT query, id, score, 'dual' FROM t20")
def retrieve_modes(s, d):
    sem, gr, dual = semantic(s, d), by_graph(s, d), ranked(s, d)
    tag = lambda df, m: df.select("query", "id", "score", F.lit(m).alias("mode"))
    sem = sem.withColumn("score", F.round("score", 5))
    return tag(sem, "semantic").unionByName(tag(gr, "graph")).unionByName(tag(dual, "dual"))
