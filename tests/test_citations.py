"""Citations, model answers and resumable work against plain versions."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tesselar.functions import answers as A
from tesselar.functions import fuzzy
from tesselar.functions.models import RuleRelations
from tesselar.operators import citations as C
from tesselar.operators.progress import Ledger
from tesselar.operators.similarity import cosine_of_distance, unit


def norm(x):
    import re

    return re.sub(r"\s+", " ", re.sub(r"[^a-z0-9\s]", "", (x or "").lower())).strip()


def plain_match(name, kind, refs):
    """The three tiers one after the other over a list of references."""
    surname = norm(name.split(",")[0].strip() if "," in name else name.split(" ")[-1])
    best = None
    for r in refs:
        if kind == "Author":
            s = fuzzy.partial_ratio_of(surname, norm(r["surname"]))
            s, m, least = (min(1.0, s + 0.1) if surname and norm(r["surname"]).startswith(surname) else s), "type_author", 0.8
        elif kind == "Journal":
            s, m, least = fuzzy.ratio_of(norm(name), norm(r["journal"])), "type_journal", 0.8
        elif kind in C.CITED_TYPES:
            s, m, least = fuzzy.ratio_of(norm(name), norm(r["title"])), "type_title", 0.75
        else:
            continue
        if s >= least and (best is None or s > best[1]):
            best = r["place"], s, m
    if best:
        return best
    for r in refs:
        for field, value in (("author", r["surname"]), ("title", r["title"]), ("journal", r["journal"])):
            s = fuzzy.partial_ratio_of(norm(name), norm(value))
            if s >= 0.65 and (best is None or s > best[1]):
                best = r["place"], s, f"fuzzy_{field}"
    return best


def test_reference_tiers(spark):
    refs = [(1, 1, "Müller", 2019, "On the law of machines", "J. Law Stud."), (1, 2, "Berg", 2020, "Taxes and robots", "Tax Review"), (1, 3, "van der Berg", 2021, "Robots and taxes", "Tax Reviews"), (2, 1, "Doe", 2001, "Other", "Other J."), (1, 4, "Okafor", 1999, None, None)]
    entities = [("a", "J. Mueller", "Author"), ("b", "Berg, Anna", "Author"), ("c", "Tax Review", "Journal"), ("d", "Taxes & robots", "Citation"), ("e", "robots", "Technology"), ("f", "Doe, J.", "Author"), ("g", "zzz 2020", "Technology"), ("h", "", "Author"), ("i", "Okafor 1999", "Concept")]
    r = spark.createDataFrame(refs, "document bigint, place int, surname string, year int, title string, journal string")
    e = spark.createDataFrame([(*x, 1) for x in entities] + [("z", "Berg", "Author", 3)], "entity_id string, name string, type string, document bigint")
    got = {x.entity_id: (x.place, pytest.approx(x.confidence), x.method) for x in C.match_references(e, r).collect()}
    own = [dict(zip(("document", "place", "surname", "year", "title", "journal"), x)) for x in refs if x[0] == 1]
    expected = {k: m for k, name, kind in entities if (m := plain_match(name, kind, own))}
    assert {k: v for k, v in got.items() if v[2] != "partial"} == expected
    assert "z" not in got and got["b"][0] == 2 and C.match_references(e.limit(0), r).count() == 0


def test_partial_confidence(spark):
    rows = [(2020, "Berg", 2020, "van der Berg"), (None, "van", 2020, "van der Berg"), (None, "berg", 2020, "van der Berg"), (2020, "", 2020, "x"), (2020, "Berg", 2019, "Berg"), (2020, None, 2020, None)]
    df = spark.createDataFrame(rows, "y int, s string, ry int, ra string")
    assert [r[0] for r in df.select(C.partial_confidence(F.col("y"), F.col("s"), F.col("ry"), F.col("ra"))).collect()] == [0.65, 0.60, None, 0.50, None, 0.50]


def test_years(spark):
    df = spark.createDataFrame([("in 1999.",), ("12019",), ("v2019",), ("2019",), ("a 2019 b 2020",), ("1850",), (None,)], "t string")
    assert [r[0] for r in df.select(C.year_of(F.col("t"))).collect()] == [1999, None, None, 2019, 2019, None, None]


def test_entities_of_answers(spark):
    e = [{"name": "a", "type": "T"}, {"name": 'q"\\', "type": None}]
    texts = [json.dumps(e), "```json\n" + json.dumps(e) + "\n```", json.dumps({"entities": e}), "[]", "", None, "no json", json.dumps(e)[:-4], json.dumps({"other": e}), "```\n[]\n```", "7"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: [(x.name, x.type) for x in r.e] for r in df.select("i", A.entities(F.col("t")).alias("e")).collect()}
    full = [("a", "T"), ('q"\\', None)]
    assert got == {i: full if i < 3 else [] for i in range(len(texts))}


def test_relations_cut_off_anywhere(spark):
    rng = random.Random(1)
    whole = [{"subject": f"s{i}", "predicate": "p {x}", "object": 'o "}]', "confidence": 0.5} for i in range(4)] + [{"subject": "last", "predicate": "p", "object": "o"}]
    text = "Sure: ```json\n" + json.dumps({"relations": whole})
    ends = [text.index(json.dumps(r)) + len(json.dumps(r)) for r in whole]
    for at in [rng.randrange(len(text)) for _ in range(60)] + ends:
        n = sum(at >= e for e in ends)
        assert [r[0] for r in A.whole_relations(text[:at])] == [r["subject"] for r in whole[:n]]
    assert A.whole_relations(text)[-1] == ("last", "p", "o", 1.0) and A.whole_relations(None) == A.whole_relations("nothing") == []
    df = spark.createDataFrame([(text,), (None,), ("",)], "t string")
    assert sorted(len(r[0]) for r in df.select(A.relations(F.col("t"))).collect()) == [0, 0, 5]


def test_scores(spark):
    cases = {'{"score": 0.8}': 0.8, '```json\n{"score": 1, "x": [1]}\n```': 1.0, 'well {"score": 0.25} then': 0.25, '{"score": 0.5, "expl': 0.5, "none": 0.0, "": 0.0, '{"other": 1}': 0.0}
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "t string")
    assert {r.t: r.s for r in df.select("t", A.score(F.col("t")).alias("s")).collect()} == cases | {None: 0.0}


def test_ledger_goes_on_where_it_stopped(spark, tmp_path):
    rows = spark.createDataFrame([(f"k{i}", None if i % 4 == 0 else "x" * i) for i in range(20)], "key string, text string")
    ledger = Ledger(spark, f"file://{tmp_path}/job", "key", "string")
    assert tuple(ledger.progress(rows).first()) == (20, 0, 0, 20)
    ledger.run(rows.limit(10), len, "text")
    ledger.run(rows, len, "text")
    assert tuple(ledger.progress(rows).first()) == (20, 15, 5, 0) and ledger.open(rows).count() == 0 and ledger.log().count() == 20
    ledger.run(rows.fillna("none"), len, "text", again=True)
    assert tuple(ledger.progress(rows).first()) == (20, 20, 0, 0)


def test_rule_relations():
    text = "The Agency oversees the Board. The Council meets. Agency and very many other words before it comes to Council."
    assert RuleRelations().relations(text, ["Agency", "Board", "Council"]) == [("Agency", "oversees_the", "Board")]


def test_unit_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>")
    assert [r[0] for r in df.select(unit(F.col("v"))).collect()] == [[pytest.approx(0.6), pytest.approx(0.8)], [0.0, 0.0]]
    assert df.select(cosine_of_distance(F.lit(0.5))).first()[0] == 0.75


def test_streams_give_all_windows(spark, tmp_path):
    from tesselar.streaming import events as S

    for day in range(3):  # three files, a batch each
        rows = [(day * 10 + i, f"2024-01-0{day + 1} 10:{i:02}:00", 1, "a", 1.0, "{}") for i in range(10)]
        spark.createDataFrame(rows, "event_id bigint, ts string, user_id bigint, event_type string, value double, props string").selectExpr("event_id", "cast(ts AS timestamp_ntz) AS ts", "user_id", "event_type", "value", "props").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/events")
    src = S.source(spark, f"file://{tmp_path}/events", "*.parquet", 1)
    assert S.run_to_table(S.tumbling(src.stream), "t", closing=src).agg(F.sum("n")).first()[0] == 30
    src = S.source(spark, f"file://{tmp_path}/events", "*.parquet", 1)
    assert sorted(r.n for r in S.run_to_table(S.sessions(src.stream), "s", closing=src).collect()) == [10, 10, 10]


def test_names_in_texts(spark):
    from tesselar.operators import linkage as L

    names = spark.createDataFrame([(1, "van der Berg"), (2, "Berg"), (3, "Ber"), (4, ""), (5, None), (6, "J. Law")], "id int, name string")
    texts = spark.createDataFrame([(10, "By van der Berg, A.; J. Law Stud."), (11, "Berg (2001)"), (12, None), (13, "Bergen")], "other int, text string")
    got = {(r.id, r.other) for r in L.named_in(names, texts).collect()}
    assert got == {(1, 10), (2, 10), (2, 11), (6, 10)}


def test_broadcasts_are_checked(spark):
    from tesselar.session import bounded

    assert bounded(spark.range(5), 5).count() == 5
    with pytest.raises(ValueError, match="fixed"):
        bounded(spark.range(6), 5)
