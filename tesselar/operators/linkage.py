"""Record linkage: works, authors and journals against bibliographic references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesselar.functions import fuzzy
from tesselar.functions import text as X

REFERENCE = r"^\[(\d+)\] ([^,(]+), ([A-Z])\. \((\d{4})\)\. (.+?)\. (J\. [^,]+), (\d+), (\d+)-(\d+)"


def references(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, place, surname, initial, year, title, journal) of each bibliography line."""
    lines = documents.where(F.col("text").isNotNull()).select(key, F.explode(F.split("text", "\n")).alias("raw")).where(F.col("raw").rlike(REFERENCE))
    part = lambda i: F.regexp_extract("raw", REFERENCE, i)
    return lines.select(key, part(1).cast("int").alias("place"), part(2).alias("surname"), part(3).alias("initial"), part(4).cast("int").alias("year"), part(5).alias("title"), part(6).alias("journal"))


def keywords(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(X.match_key_spaced(text), " "), lambda w: F.length(w) > 3))


def keyword_matches(left: DataFrame, right: DataFrame, least: int = 2, share: float = 0.5) -> DataFrame:
    """(id, other, overlap, confidence): for each left title the right title with most words in common.

    ``left`` and ``right`` have (id, title). Titles meet over as many of their
    rarest words as a title over the share can't do without; the overlap is taken
    over the whole titles.
    """
    l, r = left.select("id", keywords(F.col("title")).alias("w")).where(F.size("w") > 0), right.select(F.col("id").alias("other"), keywords(F.col("title")).alias("v"))
    lw, rw = l.select("id", F.explode("w").alias("k")), r.select("other", F.explode("v").alias("k"))
    often = rw.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    ranked = lw.join(often, "k").withColumn("i", F.row_number().over(Window.partitionBy("id").orderBy("n", "k")))
    # of m words at least half must be shared, so one of the m - ceil(m / 2) + 1 rarest is
    need = l.select("id", (F.size("w") - F.ceil(F.size("w") * F.lit(share)) + 1).alias("most"))
    pairs = ranked.join(need, "id").where(F.col("i") <= F.col("most")).select("id", "k").join(rw, "k").select("id", "other").distinct()
    scored = pairs.join(l, "id").join(r, "other").withColumn("overlap", F.size(F.array_intersect("w", "v")))
    good = scored.withColumn("part", F.col("overlap") / F.size("w")).where((F.col("overlap") >= least) & (F.col("part") >= share))
    best = good.groupBy("id").agg(F.max(F.named_struct(F.lit("overlap"), "overlap", F.lit("o"), -F.col("other"), F.lit("part"), "part")).alias("b"))
    return best.select("id", (-F.col("b.o")).alias("other"), F.col("b.overlap").alias("overlap"), F.least(F.lit(0.85), 0.5 + 0.35 * F.col("b.part")).alias("confidence"))


def best_ratio(left: DataFrame, right: DataFrame, on: list[str], threshold: float, score: str = "ratio", parts: int = 1, first: bool = False, others: int | None = None) -> DataFrame:
    """(id, other, score): the most similar right title of equal ``on``, over a threshold; ties to the smaller id.

    ``score`` is ratio or sequence_ratio; with ``first`` (ratio only) the title of
    the smallest id over the threshold is taken, not the most similar. Every pair counts: a pair is left out
    only where a bound on its score is below the threshold or the best so far
    (``fuzzy.Best``). Each of ``parts`` x ``others`` cells of left and right (as many
    as ``parts`` if not given) is worked off in a task; where there are several,
    equal titles are joined before. The work is quadratic in the distinct titles
    of equal ``on``.
    """
    others = others or parts
    one, two = left.select("id", "title", *on), right.groupBy("title", *on).agg(F.min("id").alias("other"))
    equal = None
    if others > 1 and not first:
        equal = one.where("title <> ''").join(two, ["title", *on]).select("id", "other", F.lit(1.0).alias("score"))
        one = one.join(two.select("title", *on), ["title", *on], "left_anti").select("id", "title", *on)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda n: F.pmod(F.hash("title"), F.lit(n))
    keys = [*on, "li", "ri"]
    fields = {f.name: f.dataType.simpleString() for f in [*one.schema, *two.schema]}

    def cell(l, r):
        import pandas as pd

        out = []
        if len(l) and len(r):
            r = r.sort_values("other")
            best = fuzzy.Best(r["title"].tolist(), threshold, score)
            ids = r["other"].tolist()
            texts = l["title"].tolist()
            every = (next(((k, fuzzy.ratio_of(t, best.texts[k])) for k in best.within(t)), None) for t in texts) if first else best.many(texts)
            for i, found in zip(l["id"], every):
                if found:
                    out.append((i, ids[found[0]], found[1]))
        return pd.DataFrame(out, columns=["id", "other", "score"])

    left, right = one.withColumns({"li": own(parts), "ri": every(others)}), two.withColumns({"ri": own(others), "li": every(parts)})
    if parts * others > 1:  # about a cell a task, so that none is left with many at the end
        left, right = (x.repartition(2 * parts * others, *keys) for x in (left, right))
    cells = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(cell, f"id {fields['id']}, other {fields['other']}, score double")
    cells = cells if equal is None else cells.unionByName(equal)
    w = Window.partitionBy("id").orderBy(*[] if first else [F.desc("score")], "other")
    return cells.withColumn("r", F.row_number().over(w)).where("r = 1").select("id", "other", "score")


def dedupe_works(refs: DataFrame, author: float = 0.8, title: float = 0.75) -> DataFrame:
    """(ref, work): each reference with the first reference of its year it equals, in order.

    Equal are similar authors with similar titles, and the same author of the same
    year. Greedy and order-dependent, so the references of one year are worked off
    in one task; exact repeats are folded first. Titles are compared only where
    the authors can be similar (``fuzzy.PartlyAlike``).
    """

    def greedy(pdf):
        import pandas as pd

        rows = list(pdf.sort_values("ref").itertuples())
        titles, names = [r.title[:100].lower() for r in rows], [r.surname.lower() for r in rows]
        near = fuzzy.PartlyAlike(names, author)
        kept: set = set()
        first: dict[str, int] = {}
        out = []
        for i, r in enumerate(rows):
            own = names[i]
            end = first.get(own, i)
            like = (k for k in near.before(own, end) if k in kept and fuzzy.ratio_of(titles[i], titles[k]) >= title and fuzzy.partial_ratio_of(own, names[k]) >= author)
            hit = next(like, end)
            if hit == i:
                kept.add(i)
                if own:
                    first.setdefault(own, i)
            out.append((r.ref, rows[hit].ref))
        return pd.DataFrame(out, columns=["ref", "work"])

    one = refs.groupBy("surname", "year", "title").agg(F.min("ref").alias("ref"))
    return one.groupBy("year").applyInPandas(greedy, "ref string, work string")


def cascade(ids: DataFrame, *stages: tuple[str, DataFrame]) -> DataFrame:
    """(id, other, method) by the first stage that knows an id; none otherwise."""
    left, out = ids, None
    for name, found in stages:
        hit = left.join(found.select("id", "other"), "id").withColumn("method", F.lit(name))
        out = hit if out is None else out.unionByName(hit)
        left = left.join(found.select("id"), "id", "left_anti")
    rest = left.withColumn("other", F.lit(None).cast(out.schema["other"].dataType)).withColumn("method", F.lit("none"))
    return out.unionByName(rest)


def padded(text: Column) -> Column:
    """Words between single spaces, with a space at both ends."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", " ")), F.lit(" "))


def named_in(names: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, other, name, text): names (id, name) that stand as whole words in a text (other, text).

    A name meets the texts over its longest word, so nothing is compared with every text.
    """
    n = names.select("id", padded(F.col("name")).alias("name")).where(F.trim("name") != "")
    words = F.filter(F.split(F.trim("name"), " "), lambda w: w != "")
    longest = F.element_at(F.array_sort(F.transform(words, lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))), -1)["w"]
    t = texts.select("other", padded(F.col("text")).alias("text"))
    keyed = t.select("other", "text", F.explode(F.array_distinct(F.split(F.trim("text"), " "))).alias("k"))
    return n.withColumn("k", longest).join(keyed, "k").where(F.contains("text", "name")).select("id", "other", "name", "text")
