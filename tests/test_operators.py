"""Core operators against small hand-made or brute-force results."""

import random
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tesselar.functions import fuzzy, ids, models
from tesselar.functions import text as X
from tesselar.operators import chunking, closed, graph, linkage, relations, resolve, retrieval, similarity
from tesselar.plans import graph_queries, link_queries, retrieval_queries
from tesselar.sources import documents as D
from tesselar.sources import html as H

c = F.col


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in df.select("i", expression(c("x")).alias("y")).orderBy("i").collect()]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[-1]


@settings(deadline=None, max_examples=150)
@given(st.text("abcd é", max_size=20), st.text("abcd é", max_size=20))
def test_lcs_matches_table(a, b):
    assert fuzzy.lcs_length(a, b) == (lcs(a, b) if a else 0)


def test_ratios():
    assert fuzzy.ratio_of("abcd", "abed") == pytest.approx(0.75)
    assert fuzzy.ratio_of(None, "a") == 0 == fuzzy.partial_ratio_of("", "a")
    assert fuzzy.partial_ratio_of("AI Act", "the EU AI Act of 2024") == 1.0
    assert fuzzy.partial_ratio_of("Nature", "machine learning") < 0.8


def test_identifiers(spark):
    names = column(spark, ["EU AI Act", " eu ai act "], lambda x: ids.entity_id(x, F.lit("Regulation")))
    assert names[0] == names[1] and names[0].startswith("ent_") and len(names[0]) == 16
    assert column(spark, ["a_CHUNK_1_CHUNK_0007", "x"], lambda x: ids.chunk_parts(x)[0]) == ["a_CHUNK_1", None]
    assert column(spark, ["ent_a", "d_CHUNK_0001", "pub_l1_x", "author_5", "journal_x", "rel_x", "?"], ids.id_type) == ["entity", "chunk", "publication", "author", "journal", "relation", "unknown"]


def test_garbage_names(spark):
    bad = ["...", "..", "…", "N/A", "NA", "n/a", "80%", "who", "RQ1", "R", "Ra", "k", "", None]
    good = ["AI", "ML", "EU", "UK", "US", "UAE", "GDPR", "FDA", "G20", "FP7"]
    assert column(spark, bad, lambda x: X.garbage_name(x, F.lit("Technology"))) == [True] * len(bad)
    assert column(spark, good, lambda x: X.garbage_name(x, F.lit("Technology"))) == [False] * len(good)
    assert column(spark, ["4", "[3]", "18"], lambda x: X.garbage_name(x, F.lit("Citation"))) == [False] * 3
    assert column(spark, ["4", "[3]"], lambda x: X.garbage_name(x, F.lit("Journal"))) == [True, True]


def test_cleaning(spark):
    assert column(spark, ["<td>a</td> $1923^{40}$ \\textbf{AI} mail a.b@c.org ![x](y.png)"], lambda x: X.clean_text(x, F.lit(True))) == ["a 192340 AI mail"]
    paper = "# Intro\ntext\n# Funding\nmoney\n# References\n[1] A, B. (2001). A long title here.\n[2] short\n# End\nx"
    assert column(spark, [paper], X.drop_sections) == ["# Intro\ntext\n# References\n[1] A, B. (2001). A long title here.\n[2] short\n# End\nx"]
    assert column(spark, [paper], lambda x: X.split_references(X.reference_section(x))) == [["[1] A, B. (2001). A long title here."]]
    assert column(spark, ["applies_to", "is Part of!"], X.normal_predicate) == ["appliesto", "is_part_of"]
    assert column(spark, ["a [3] b [1][3]", ""], X.cited_indices) == [[1, 3], []]
    assert column(spark, ["see https://doi.org/10.1000/abc.5.", "10.1000/x and 10.1000/y"], X.doi) == ["10.1000/abc.5", None]
    assert column(spark, ["aa bb cc dd"], lambda x: X.pack(F.split(x, " "), 5)) == [["aa bb", "cc dd"]]
    assert column(spark, [None, "", "  ", "a  b"], X.token_count) == [None, 0, 0, 2]


def test_merge_group_votes_and_unites(spark):
    rows = [(1, "Machine Learning", "Technology", "short", "c1"), (2, "machine learning", "Concept", "a longer one", "c2"), (3, "machine learning", "Concept", None, "c1")]
    m = spark.createDataFrame(rows, "o bigint, name string, type string, description string, chunk_id string")
    r = resolve.merge_groups(m, X.normal_name(c("name")), "o").first()
    assert (r["name"], r["type"], r.description, r.chunk_ids, r.aliases, r.merge_count) == ("machine learning", "Concept", "a longer one", ["c1", "c2"], [], 3)


def test_provenance(spark):
    m = spark.createDataFrame([("EU AI Act", "c1"), ("eu ai act", "c1"), ("Nature", "c1"), ("x", "gone")], "name string, chunk_id string")
    k = spark.createDataFrame([("c1", "The EU AI Act applies."), ("c2", None)], "chunk_id string, text string")
    for f in (resolve.provenance, resolve.fuzzy_provenance):
        assert {(r["name"], r.in_source) for r in f(m, k).collect()} == {("EU AI Act", True), ("eu ai act", True), ("Nature", False), ("x", True)}


def brute_components(pairs):
    of = {}
    for a, b in pairs:
        x, y = of.get(a, {a}), of.get(b, {b})
        for n in (u := x | y):
            of[n] = u
    return {n: min(u) for n, u in of.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(20)]
    got = graph.components(spark.createDataFrame(pairs, "src int, dst int"))
    assert {r.node: r.component for r in got.collect()} == brute_components([p for p in pairs if p[0] != p[1]])


def test_components_of_nothing(spark):
    assert graph.components(spark.createDataFrame([], "src int, dst int")).count() == 0


def test_triangles_and_distances(spark):
    rng = random.Random(5)
    pairs = {tuple(sorted((rng.randrange(12), rng.randrange(12)))) for _ in range(30)}
    pairs = {p for p in pairs if p[0] != p[1]}
    e = spark.createDataFrame([*pairs, *list(pairs)[:3]], "src int, dst int")
    expected = {t for t in combinations(range(12), 3) if all(p in pairs for p in combinations(t, 2))}
    assert {tuple(r) for r in graph.triangles(e).collect()} == expected
    assert graph.triangle_count(graph.simple(e)).first().triangles == len(expected)
    line = spark.createDataFrame([(i, i + 1) for i in range(6)], "src int, dst int")
    far = graph.distances(line, spark.createDataFrame([(0,)], "id int"), 4)
    assert {r.node: r.distance for r in far.collect()} == {i: i for i in range(5)}


def test_frontiers_of_many_sources_go_together(spark, monkeypatch):
    """A row a node and batch, not one a source and node; distances equal brute force."""
    monkeypatch.setattr(graph, "TOGETHER", 5)
    rng = random.Random(6)
    pairs = [(rng.randrange(40), rng.randrange(40)) for _ in range(45)]
    edges = spark.createDataFrame([*pairs, *pairs[:5], (3, None)], "src bigint, dst bigint")
    near = {n: {y for p in pairs for x, y in (p, p[::-1]) if x == n} for n in range(40)}
    expected = {}
    for s in range(12):
        expected[s, s], front = 0, {s}
        for hop in range(1, 4):
            front = {y for x in front for y in near[x] if (s, y) not in expected}
            expected |= {(s, y): hop for y in front}
    sources = spark.createDataFrame([(i,) for i in range(12)], "id bigint")
    assert {(r.source, r.node): r.distance for r in graph.distances(edges, sources, 3).collect()} == expected
    counts = {r.distance: r.n for r in graph.path_lengths(edges, sources, 3).collect()}
    assert counts == {h: sum(d == h for d in expected.values()) for h in range(4)}
    _, levels = graph._levels(edges, sources, 3)
    assert all(x.count() <= 40 * 3 for x in levels) and not [t for t in spark.catalog.listTables() if t.name.startswith("near_")]


def test_clustering_of_packed_pairs(spark, tmp_path, monkeypatch):
    """Equal to brute force with hubs, repeats and nulls, whatever is held at once; a list is not sent along each of its edges."""
    rng = random.Random(8)
    groups = [[rng.randrange(150) for _ in range(rng.randrange(6))] for _ in range(400)] + [list(range(60)), [7], [7, 7]]
    rows = [(s, o) for o, g in enumerate(groups) for s in [*g, *g[:1]]] + [(None, 1), (3, None)]
    pairs = {p for g in groups for p in combinations(sorted(set(g)), 2)}
    near = {n: {a + b - n for a, b in pairs if n in (a, b)} for n in range(150)}
    expected = (sum(len(near[a] & near[b]) for a, b in pairs) // 3, sum(len(x) * (len(x) - 1) // 2 for x in near.values()))
    for held in (closed.HELD, 50):
        monkeypatch.setattr(closed, "HELD", held)
        packed = closed.packed_co_members(spark.createDataFrame(rows, "src bigint, dst bigint"))
        assert tuple(graph.clustering(packed).first())[:2] == expected
    assert closed.count(*closed.packed_edges(spark.createDataFrame([*pairs, *[(b, a) for a, b in pairs]], "a int, b int"))) == expected
    monkeypatch.setattr(closed, "CELL", 20)  # 256 cells and more
    assert closed.count(*closed.packed_edges(spark.createDataFrame([*pairs], "a int, b int"))) == expected
    every = np.array([u << 32 | v for u, v in combinations(range(300), 2)])
    assert len(closed.pack(every)) < 2 * len(every) and (closed.unpack(closed.pack(every), len(every)) == every).all()
    one = spark.createDataFrame([(1, 5), (2, 5)], "l_suppkey bigint, l_orderkey bigint")
    one.write.parquet(str(tmp_path / "lineitem.parquet"))
    got = graph_queries.g_clustering(spark, str(tmp_path)).first()  # no path of two edges: ended with a division by zero
    assert (got.triangles, got.wedges) == (0, 0) and got.coefficient != got.coefficient


def test_capped_union(spark):
    pairs = spark.createDataFrame([("a", "b", 1), ("c", "d", 2), ("b", "c", 3), ("x", "y", 4)], "a string, b string, ord int")
    roots = {r.node: r.root for r in resolve.capped_union(pairs, 3).collect()}
    assert roots["a"] == roots["b"] != roots["c"] == roots["d"] and roots["x"] == roots["y"]


def test_capped_union_by_rounds(spark):
    """The same groups and roots as one pair after the other, for components over the bound of a task."""
    import random

    rng = random.Random(3)
    rows = [(rng.randrange(60), rng.randrange(60), i) for i in range(150)]
    pairs = spark.createDataFrame([r for r in rows if r[0] != r[1]], "a int, b int, ord int")
    of = lambda n: {(r.node, r.root) for r in resolve.capped_union(pairs, 7, n).collect()}
    assert of(100_000) == of(0)


def test_bridge_cut(spark):
    group = lambda p: [(f"{p}{i}", f"{p}{j}", 0.95) for i, j in combinations(range(4), 2)]
    links = spark.createDataFrame([*group("a"), *group("b"), ("a0", "b0", 0.89)], "a string, b string, similarity double")
    left = {(r.a, r.b) for r in resolve.bridge_cut(links).collect()}
    assert ("a0", "b0") not in left and len(left) == 12


def test_bridge_cut_counts_only_parts_that_a_cut_can_change(spark, monkeypatch):
    rng = random.Random(2)
    links = {tuple(sorted((40 * g + i, 40 * g + rng.randrange(max(0, i - 6), i)))): round(rng.uniform(0.38, 0.95), 2) for g in range(3) for i in range(1, 40) for _ in range(2)}
    kept, cuts, counts = dict(links), 0, 0
    while True:
        of = brute_components(kept)
        groups = [(sorted(n for n in of if of[n] == m), [e for e in kept if of[e[0]] == m]) for m in sorted(set(of.values()))]
        bad = [(x, e) for n, own in groups if len(n) >= 5 and len(own) >= 3 for e, x in resolve.edge_betweenness(n, own).items() if x > 0.25 and kept[e] < 0.91]
        counts += sum(len(n) >= 5 and len(own) >= 3 for n, own in groups)
        big = max(groups, key=lambda g: len(g[0]))
        if not bad and len(big[0]) <= 20:
            break
        del kept[max(bad)[1] if bad else min(big[1], key=lambda e: (kept[e], e))]
        cuts += 1
    counted, count = [], resolve.edge_betweenness
    monkeypatch.setattr(resolve, "edge_betweenness", lambda *a: counted.append(1) or count(*a))

    rows = spark.createDataFrame([(*e, x) for e, x in links.items()], "a int, b int, similarity double")
    assert {(r.a, r.b) for r in resolve.bridge_cut(rows).collect()} == set(kept)
    import pandas as pd

    cut = resolve._cutter(5, 3, 0.25, 0.91, 20, 1000)
    left = cut(pd.DataFrame([(*e, x) for e, x in links.items()], columns=["a", "b", "similarity"]))
    assert set(zip(left.a, left.b)) == set(kept) and cuts > 10
    assert len(counted) < counts / 3  # before: all parts at each cut


def test_similar_pairs_and_search(spark):
    rng = np.random.default_rng(1)
    v = rng.standard_normal((40, 8))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(99, None)], "id int, v array<double>")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = unit @ unit.T
    got = {(r.a, r.b) for r in similarity.similar_pairs(df, 0.4, "id", "v", 3).collect()}
    assert got == {(i, j) for i, j in combinations(range(40), 2) if s[i, j] >= 0.4}
    found = similarity.search(df.where("id < 3").select(c("id").alias("query"), c("v").alias("qv")), df, 4)
    for i in range(3):
        assert [r.id for r in found.where(f"query = {i}").orderBy("rank").collect()] == list(np.argsort(-s[i], kind="stable")[:4])


def test_budgets(spark):
    df = spark.createDataFrame([("g", i, x) for i, x in enumerate([40, 30, 50, 10])], "g string, i int, n int")
    assert [r.i for r in relations.budgeted(df, ["g"], [c("i")], c("n"), 80).collect()] == [0, 1]
    assert [(r.i, r.granted) for r in relations.fitted(df, ["g"], [c("i")], c("n"), 100, 20).orderBy("i").collect()] == [(0, 40), (1, 30), (2, 30)]


def test_diverse_selection(spark):
    rows = [("q", "a", 0, 0.9, [1.0, 0.0], ["x"]), ("q", "b", 1, 0.89, [1.0, 0.01], ["x"]), ("q", "c", 2, 0.5, [0.0, 1.0], ["y", "z"])]
    df = spark.createDataFrame(rows, "query string, id string, ord int, relevance double, vector array<double>, members array<string>")
    assert [r.id for r in relations.select_diverse(df, 2, 0.5).orderBy("place").collect()] == ["a", "c"]
    assert [r.id for r in relations.select_diverse(df, 1, 0.5, coverage=True).orderBy("place").collect()] == ["c"]


def test_relation_validation(spark):
    m = spark.createDataFrame([("a", "c1"), ("b", "c1"), ("d", "c2")], "entity_id string, chunk_id string")
    r = spark.createDataFrame([("a", "b"), ("a", "d"), ("z", "b"), ("a", "z")], "subject string, object string")
    assert {(x.subject, x.object): x.reason for x in relations.validated(r, m).collect()} == {("a", "b"): "valid", ("a", "d"): "no_cooccurrence", ("z", "b"): "subject_not_found", ("a", "z"): "object_not_found"}


def test_semantic_chunks(spark):
    text = "Cats purr. Cats sleep. Cats eat. Taxes rise. Taxes fall. Taxes stay. Taxes end."
    s = spark.createDataFrame([(1, 0, None, text), (1, 1, "H", "One. Two."), (2, 0, None, " ")], "doc_id int, section bigint, header string, content string")
    rows = chunking.chunk_sections(s, key="doc_id").orderBy("doc_id", "section", "part").collect()
    assert [(r.section, r.sentence_count) for r in rows] == [(0, 3), (0, 4), (1, 2)]
    assert " ".join(r.text for r in rows if r.section == 0) == text


def test_penalties_and_winners(spark):
    df = spark.createDataFrame([("EU", "regulation"), ("US", "regulation"), (None, "paper"), ("US", "paper")], "j string, k string")
    got = [round(r[0], 4) for r in df.select(retrieval.penalty(c("j"), c("k"), F.array(F.lit("EU")), F.array(F.lit("regulation")))).collect()]
    assert got == [1.0, 0.9, 0.85, 0.765]
    w = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 0.5, 0.5, 0.5), (3, 0.5, 0.5, 0.1), (4, 0.1, 0.2, 0.2), (5, 0.1, 0.2, 0.3)], "query int, semantic double, graph double, dual double")
    assert {r.query: r.winner for r in retrieval.winners(w).collect()} == {1: "N/A", 2: "tie", 3: "semantic", 4: "graph", 5: "dual"}


def test_steiner_connects_terminals(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (2, 9)], "src int, dst int")
    t = spark.createDataFrame([("q", 1), ("q", 4), ("r", 7)], "query string, id int")
    got = {(r.query, r.id) for r in retrieval.steiner(t, e).collect()}
    assert got == {("q", 1), ("q", 2), ("q", 3), ("q", 4), ("r", 7)}


def test_keyword_matches(spark):
    left = spark.createDataFrame([(1, "governing artificial intelligence risk"), (2, "unrelated words entirely")], "id bigint, title string")
    right = spark.createDataFrame([(5, "artificial intelligence risk and law"), (6, "risk of intelligence")], "id bigint, title string")
    assert [(r.id, r.other, r.overlap) for r in linkage.keyword_matches(left, right).collect()] == [(1, 5, 3)]


@pytest.mark.parametrize("score", ["ratio", "sequence_ratio"])
def test_best_ratio_equals_brute_force(spark, score):
    rng = random.Random(7)
    f = getattr(fuzzy, score + "_of")
    vocabulary = ["the", "eu", "ai", "act", "on", "governing", "risk", "of", "quality", "zone", "liability", "jury"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    for size, threshold in ((5, 0.6), (40, 0.6), (70, 0.5)):  # from 200 characters on popular ones start no block
        right = [text(size) for _ in range(25)]
        left = [text(size) for _ in range(10)] + [r[4:] for r in right[:5]] + ["x" + r for r in right[5:10]] + [right[3]]
        best = fuzzy.Best(right, threshold, score)
        for t in left:
            i = max(range(len(right)), key=lambda i: (f(t, right[i]), -i))
            assert best.of(t) == ((i, f(t, right[i])) if f(t, right[i]) >= threshold else None)
            assert all(u >= f(t, r) - 1e-9 for u, r in zip(best.bounds(t), right))


def test_sequence_matches_without_a_matcher(monkeypatch):
    """Equal to SequenceMatcher over all pairs, with and without popular characters, but it isn't asked for any."""
    rng = random.Random(11)
    cases = []
    for letters, least, most in (("ab ", 1, 12), ("abcdefghéß  ", 5, 130), ("abcdefghijklmnopqxyz0123  ", 150, 320), ("ab cqz", 190, 260)):
        words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(12)]
        text = lambda: " ".join(rng.choice(words) for _ in range(most))[: rng.randint(least, most)]  # noqa: E731, B023
        right = [text() for _ in range(50)]
        left = [text() for _ in range(15)] + [r[3:] + "x" for r in right[:8]] + ["zz" + r[: len(r) // 2] + text() for r in right[8:16]] + [None, "", right[4]]
        rated = [[fuzzy.sequence_ratio_of(t, r) for r in right] for t in left]
        for threshold in (0.3, 0.6):
            best = [max(range(len(right)), key=lambda i: (x[i], -i)) for x in rated]  # noqa: B023
            cases.append((right, left, threshold, [(i, x[i]) if x[i] >= threshold else None for i, x in zip(best, rated)]))

    def asked(*_):
        raise AssertionError("a pair was left to SequenceMatcher")

    monkeypatch.setattr(fuzzy, "SequenceMatcher", asked)  # before: once a pair that the bounds left
    monkeypatch.setattr(fuzzy._Short, "FIRST", 10)
    for right, left, threshold, expected in cases:
        assert fuzzy.Best(right, threshold, "sequence_ratio").many(left) == expected


def test_titles_of_the_same_words_are_seldom_compared(monkeypatch):
    """Titles far by their beginnings and ends stay behind the bound, and no best one does."""
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("eeeaattooiinnssrrhldcumpfg") for _ in range(rng.randint(*n)))
    adjectives, nouns = [word((5, 13)) for _ in range(7)], [word((5, 13)) for _ in range(7)]
    title = lambda: f"{rng.choice(adjectives)} {rng.choice(nouns)} and the {word((4, 12))} of {rng.choice(adjectives)} {rng.choice(nouns)}"
    right = [title() for _ in range(1500)] + ["short", "two words", "é" * 30 + " " + "x" * 40 + " " + " ".join(adjectives)]
    left = [title() for _ in range(20)] + ["shorts", " ".join(right[:4]), "nothing alike 123"]
    for back in (False, True):
        ends = fuzzy._Ends(right, back)
        far = ends.distances(left)
        assert len(ends.lengths) < 70 and far.max() > 12
        for i, t in enumerate(left[:3] + left[-3:]):
            t, places = (t[::-1] if back else t), {p: k for k, p in zip(ends.of, (ends._part(r.split(" "), 2) for r in right))}
            for p, k in places.items():
                assert far[left.index(t[::-1] if back else t), k] <= min(n + len(p) - 2 * fuzzy.lcs_length(t[:n], p) if n and p else n + len(p) for n in range(len(t) + 1)), i
    compared, passing = 0, fuzzy._Short._passing

    def counted(self, texts, of, *a):
        nonlocal compared
        compared += len(of)
        return passing(self, texts, of, *a)

    monkeypatch.setattr(fuzzy._Short, "_passing", counted)
    rated = [[fuzzy.sequence_ratio_of(t, r) for r in right] for t in left]
    assert fuzzy.Best(right, 0.6, "sequence_ratio").many(left) == [(x.index(max(x)), max(x)) if max(x) >= 0.6 else None for x in rated]
    assert compared < 0.3 * len(left) * len(right)


def test_abstracts_at_a_weak_threshold_are_seldom_compared(monkeypatch):
    """Texts of other sentences stay behind the bound: one block more than common characters that aren't popular, not two for each."""
    rng = random.Random(5)
    words = ["".join(rng.choice("eeeeeeaaaaatttttooooiiiinnnnsssrrrhhlldcumpfgwybvkxjqz") for _ in range(rng.randint(3, 9))) for _ in range(300)]
    right = [" ".join(rng.choice(words) for _ in range(150))[:800] for _ in range(60)]
    left = [r[:300] + " h2 p " + r[330:790] for r in right[:20]] + [" ".join(rng.choice(words) for _ in range(150))[:800] for _ in range(20)]
    rated, blocks = 0, fuzzy._anchored_blocks_of

    def counted(*a):
        nonlocal rated
        rated += 1
        return blocks(*a)

    monkeypatch.setattr(fuzzy, "_anchored_blocks_of", counted)
    got = fuzzy.Best(right, 0.6, "sequence_ratio").many(left)
    own = [fuzzy.sequence_ratio_of(t, r) for t, r in zip(left[:20], right)]
    assert got == [(i, x) if x >= 0.6 else None for i, x in enumerate(own)] + [None] * 20 and sum(x >= 0.6 for x in own) > 10
    assert rated < 100  # of 2,400 pairs


def test_partial_ratio_of_all_windows_at_once(monkeypatch):
    rng = random.Random(4)
    text = lambda n, of="abcde é": "".join(rng.choice(of) for _ in range(n))
    brute = lambda a, b: max(fuzzy.ratio_of(a, b[max(0, i) : i + len(a)]) for i in range(1 - len(a), len(b)))
    pairs = [(text(n), text(m)) for n, m in [(1, 50), (3, 41), (20, 200), (63, 90), (64, 300), (65, 130), (140, 200), (70, 70)] for _ in range(4)] + [("xyz", "q" * 60)]
    rated = 0
    ratio_of = fuzzy.ratio_of
    expected = [1.0 if a in b else brute(a, b) for a, b in pairs]

    def counted(a, b):
        nonlocal rated
        rated += 1
        return ratio_of(a, b)

    monkeypatch.setattr(fuzzy, "ratio_of", counted)
    assert [fuzzy.partial_ratio_of(*p) for p in pairs] == expected == fuzzy._partial_ratios(*zip(*pairs))
    assert fuzzy._partial_ratios([b for _, b in pairs[:28]], [a for a, _ in pairs[:28]]) == expected[:28]
    assert fuzzy._partial_ratios([None, "", "a"], ["a" * 50, "b", "a"]) == [0.0, 0.0, 1.0]
    assert rated == 0  # before: once a window


def test_works_of_other_authors_are_not_compared(spark, monkeypatch):
    """Equal to all comparisons in order; titles of authors that can't be similar aren't rated."""
    rng = random.Random(9)
    name = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9)))
    names = [name() for _ in range(40)]
    rows = [(f"r{i:03}", rng.choice([*names, name(), ""]), 2019, "ethics of " + "".join(rng.choice("ab") for _ in range(6))) for i in range(150)]
    kept, expected = [], {}
    for ref, own, _, title in rows:
        like = [k for k in kept if own and k[1] == own or fuzzy.partial_ratio_of(own, k[1]) >= 0.8 and fuzzy.ratio_of(title, k[3]) >= 0.75]
        expected[ref] = like[0][0] if like else ref
        if not like:
            kept.append((ref, own, 2019, title))
    rows = [(r, o, y, t) for r, o, y, t in rows]
    folded = {(o, y, t): r for r, o, y, t in reversed(rows)}
    got = {r.ref: r.work for r in linkage.dedupe_works(spark.createDataFrame(rows, "ref string, surname string, year int, title string")).collect()}
    assert set(got) == set(folded.values()) and len(set(got.values())) < len(got)
    assert got == {r: expected[r] for r in got}
    alike = fuzzy.PartlyAlike(names, 0.8)
    for n in names[:10]:
        assert {k for k, x in enumerate(names) if fuzzy.partial_ratio_of(n, x) >= 0.8} <= set(alike.before(n, len(names)))
    assert list(fuzzy.PartlyAlike(["smith", "jones", "smyth"], 0.8).before("smith", 3)) == [0, 2]


def test_best_ratio_of_other_beginnings(spark):
    left = spark.createDataFrame([("a", "the eu ai act"), ("b", "governnig risk"), ("c", "nothing alike")], "id string, title string")
    right = spark.createDataFrame([("2", "eu ai act"), ("1", "eu ai act"), ("3", "governing risk"), ("4", "qqqq")], "id string, title string")
    for parts in (1, 3):
        got = {r.id: (r.other, round(r.score, 3)) for r in linkage.best_ratio(left, right, [], 0.6, "sequence_ratio", parts).collect()}
        assert got == {"a": ("1", 0.818), "b": ("3", 0.929)}


def test_cascade_rates_only_what_is_not_linked_yet(spark, tmp_path, monkeypatch):
    from tesselar.plans import link_queries

    text = "the committee reviewed the quarterly risk figures and published a short report on them " * 3
    raw = [("r1", "Governing Risk In Practice", text), ("r2", "Governnig risk of practice", text), ("r3", None, text + "x"), ("r4", None, "too short")]
    spark.createDataFrame([(*r, "regulation") for r in raw], "doc_id string, title string, text string, source_type string").write.parquet(f"{tmp_path}/raw_documents.parquet")
    spark.createDataFrame([(7, "Governing risk in practice")], "doc_id bigint, title string").write.parquet(f"{tmp_path}/documents.parquet")
    rated, best_ratio = [], link_queries.L.best_ratio

    def watched(left, *a, **k):
        rated.append({r.id for r in left.select("id").collect()})
        return best_ratio(left, *a, **k)

    monkeypatch.setattr(link_queries.L, "best_ratio", watched)
    got = {r.id: (r.other, r.method) for r in link_queries.link_cascade(spark, str(tmp_path)).collect()}
    assert got == {"r1": ("7", "exact"), "r2": ("7", "title"), "r3": ("r3", "abstract"), "r4": (None, "none")}
    assert rated == [{"r2"}, {"r3"}]  # before: all with a title, all with a text


def test_cascade_deals_few_abstracts_to_few_cells(spark, tmp_path, monkeypatch):
    """The other side is rated once where one part holds all that is left, not in sixteen parts."""
    text = "the committee reviewed the quarterly risk figures and published a short report on them " * 3
    spark.createDataFrame([("r1", None, text, "regulation")], "doc_id string, title string, text string, source_type string").write.parquet(f"{tmp_path}/raw_documents.parquet")
    spark.createDataFrame([(7, "Governing risk in practice")], "doc_id bigint, title string").write.parquet(f"{tmp_path}/documents.parquet")
    cells, best_ratio = [], link_queries.L.best_ratio

    def watched(*a, others):
        cells.append((a[5], others))
        return best_ratio(*a, others=others)

    monkeypatch.setattr(link_queries.L, "best_ratio", watched)
    assert [(r.id, r.other, r.method) for r in link_queries.link_cascade(spark, str(tmp_path)).collect()] == [("r1", "r1", "abstract")]
    assert cells[1] == (1, 24)


def test_authors_and_journals_of_other_beginnings(spark, tmp_path):
    spark.createDataFrame([("e1", "Author", "Mueller, A."), ("e2", "Author", "Mueller, B."), ("e3", "Journal", "Journal of Law")], "entity_id string, type string, name string").write.parquet(str(tmp_path / "entities.parquet"))
    spark.createDataFrame([(1, "Author", "Moeller, A."), (2, "Journal", "The Journal of Law")], "pre_id bigint, type string, name string").write.parquet(str(tmp_path / "pre_entities.parquet"))
    assert [(r.id, r.other, round(r.score, 3)) for r in link_queries.match_author(spark, str(tmp_path)).collect()] == [("e1", 1, 0.857)]
    assert [(r.id, r.other, round(r.score, 3)) for r in link_queries.match_journal(spark, str(tmp_path)).collect()] == [("e3", 2, 0.875)]


def test_dedupe_works_and_cascade(spark):
    refs = spark.createDataFrame([("r1", "Smith", 2019, "Ethics of machines"), ("r2", "Smith", 2019, "Ethics of machine"), ("r3", "Smith", 2020, "Ethics of machines")], "ref string, surname string, year int, title string")
    assert {r.ref: r.work for r in linkage.dedupe_works(refs).collect()} == {"r1": "r1", "r2": "r1", "r3": "r3"}
    ids_ = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    one, two = spark.createDataFrame([(1, "a")], "id int, other string"), spark.createDataFrame([(1, "b"), (2, "b")], "id int, other string")
    assert {(r.id, r.other, r.method) for r in linkage.cascade(ids_, ("x", one), ("y", two)).collect()} == {(1, "a", "x"), (2, "b", "y"), (3, None, "none")}


def test_dedupe_works_across_first_letters_and_by_equal_author(spark):
    refs = spark.createDataFrame([("r1", "van der Berg", 2019, "Ethics of machines"), ("r2", "Berg", 2019, "Ethics of machine"), ("r3", "Berg", 2019, "Another thing"), ("r4", "Lee", 2019, "Ethics of machines"), ("r5", "Lee", 2019, "Quite unlike")], "ref string, surname string, year int, title string")
    assert {r.ref: r.work for r in linkage.dedupe_works(refs).collect()} == {"r1": "r1", "r2": "r1", "r3": "r3", "r4": "r4", "r5": "r4"}


def test_same_as_takes_the_first_similar_regulation(spark):
    rng = random.Random(3)
    regs = [(i, "".join(rng.choice("abcd ") for _ in range(8)).strip() or "a") for i in range(120)]
    docs = [("d1", "data act 2023"), ("d2", "eu ai act"), *((f"x{i}", t[:-1] + "b") for i, t in regs[60:])]
    regs += [(200, "data act 2024"), (201, "data act 2023"), (202, "gdpr")]
    expected = {d: next(i for i, r in regs if fuzzy.ratio_of(t, r) >= 0.85) for d, t in docs if any(fuzzy.ratio_of(t, r) >= 0.85 for _, r in regs)}
    got = linkage.best_ratio(spark.createDataFrame(docs, "id string, title string"), spark.createDataFrame(regs, "id int, title string"), [], 0.85, parts=2, first=True)
    assert {r.id: r.other for r in got.collect()} == expected and expected["d1"] == 200 and len(expected) > 20


def test_penalties_of_all_chunks(spark, tmp_path):
    spark.createDataFrame([(i, "x", [1.0]) for i in range(101)], "vec_id bigint, label string, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = retrieval_queries.filter_penalty(spark, str(tmp_path))
    assert got.count() == 303 and {r.id for r in got.select("id").distinct().collect()} == set(range(101))


PAGE = """<div class="page-nav-accordion__item"><a class="page-nav-accordion__title">Law</a><div class="page-nav-accordion__content"><h1>Law in X</h1><p>One <b>bold<p>Two <a href="#t">t</a> <a href="http://e.org">e</a></p>
<div class="note"><h3>France</h3><p>noted</p></div><h4>Ohio</h4><p>state</p></div></div><div class="page-nav-accordion__item"><a class="page-nav-accordion__title">Key contacts</a><div class="page-nav-accordion__content"><p>x</p></div></div>"""


def test_html_sections(spark):
    got = H.sections(PAGE)
    assert len(got) == 1
    s = got[0]
    assert (s["title"], s["heading"]) == ("Law", "Law in X")
    assert "noted" not in s["main_content"] and "state" not in s["main_content"] and "Two" in s["main_content"]
    assert s["links"] == [{"text": "e", "url": "http://e.org"}] and s["subsections"] == [{"heading": "Ohio", "content": "state"}] and s["notes"][0]["heading"] == "France"
    df = spark.createDataFrame([(1, PAGE), (2, None), (3, "<p>")], "id int, html string")
    assert H.html_sections(df, "id", "html").count() == 1


def test_regulations_and_bibliography(spark, tmp_path):
    (tmp_path / "eu.json").write_text('{"country_code":"EU","country_name":"European Union","url":"u","scraped_date":"d","num_sections":1,"sections":[{"title":"T","heading":"H","main_content":"body"},{"title":"S","heading":"S","main_content":"more"}]}')
    (tmp_path / "bad.json").write_text("{nope")
    rows = D.read_regulations(spark, str(tmp_path)).collect()
    assert len(rows) == 1 and rows[0].doc_id == "reg_EU" and rows[0].text == "# T\n## H\n\nbody\n\n---\n\n# S\n\nmore\n\n---\n\n"
    (tmp_path / "b.csv").write_text('﻿EID,Title,Year,DOI,Source title,Author(s) ID,Author full names,ISSN,References\n1,"A, b",2020,10.1/x,J,"11; 22","Smith, J. (11)",1,"Doe, A., Title, Venue, (2001); Solo"\n', encoding="utf-8")
    b = D.read_bibliography(spark, str(tmp_path / "b.csv"))
    assert b.columns[0] == "EID"
    refs = D.parse_references(b, "EID", "References").orderBy("place").collect()
    assert [(r.author, r.title, r.journal, r.year) for r in refs] == [("Doe, A.", "Title", "Venue", 2001), ("Solo", "", "", None)]
    assert {r.name for r in D.bibliography_nodes(b)["authors"].collect()} == {"Smith, J.", "Author 22"}


def test_model_stand_ins(spark):
    df = spark.createDataFrame([("c", "The Data Act 2024 and Article 5 cite [3]."), ("d", None)], "chunk_id string, text string")
    assert {(r.name, r.type) for r in models.extract_entities(df).collect()} >= {("Article 5", "DocumentSection"), ("[3]", "Citation")}
    pairs = spark.createDataFrame([("Artificial Intelligence", "AI"), ("GPT 3", "GPT 4"), (None, "x")], "name_a string, name_b string")
    assert [r.same for r in models.judge_pairs(pairs).collect()] == [True, False, False]
