"""Operators against hand-worked results, and the registered queries against DuckDB."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from quarrygraph.functions import intent, text, vector
from quarrygraph.operators import evaluate, graph, meetings, pairs
from quarrygraph.operators.components import connected_components
from quarrygraph.plans.registry import ORACLE_SQL, QUERIES
from quarrygraph.sources.tables import ensure_checkpoint_dir

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_text(spark):
    assert one(spark, text.normalize_answer(F.lit("The years 1990 to 1995."))) == "years 19901995"
    assert one(spark, text.extract_final_answer(F.lit("**Final Answer:** Paris.\nmore"))) == "Paris"
    assert one(spark, text.contain_match(F.lit("Yes, it is"), F.lit("yes"))) == 0
    assert one(spark, text.clean_entity(F.lit("Ed Wood, Jr."))) == "edwood"
    assert one(spark, text.clean_entity(F.lit("  Ed\tWood JR.\n"))) == "edwood" and one(spark, text.clean_entity(F.lit("Dr Sultanate"))) == "drsultanate"
    assert one(spark, text.generation(F.lit("Ed Wood Jr. "))) == one(spark, text.generation(F.lit("Ed Wood II"))) != one(spark, text.generation(F.lit("Ed Wood sr")))
    assert one(spark, text.generation(F.lit("Ed Woodjr"))) is None
    assert one(spark, text.selected_indices(F.lit("ID 3, 12 and 0"), F.lit(5))) == [3, 0]
    assert one(spark, text.enriched_name(F.lit(" Ann "), F.array(F.lit("Ann"), F.lit("A."), F.lit(None)))) == "Ann, synonyms: A."
    assert one(spark, text.purify_query(F.lit("where was Ada born"), ("where", "was"))) == "Ada born"


def test_edge_weight(spark):
    w = lambda e, i, s: one(spark, vector.edge_weight(F.lit(e), F.lit(i), F.lit(s), 0.15, 0.30, 0.55))
    assert w(True, 0.0, 0.5) == pytest.approx(0.425)
    assert w(False, 0.5, 0.4) == pytest.approx(0.36)
    assert w(False, 0.9, 0.3) == 0.0


def test_modulation(spark):
    m = one(spark, intent.modulate(F.lit(0.2), F.lit(0.3), F.lit(0.5), F.lit(0), F.lit(0), F.lit(5)))
    assert m["intent"] == "Default" and m["top"] == pytest.approx(0.5085, abs=1e-4)


def test_cooccurrence(spark):
    rows = [(0, "a", "b", 1), (0, "a", "b", 1), (0, "a", "c", 1), (0, "b", "b", 2)]
    found = graph.cooccurrence(spark.createDataFrame(rows, "context_id long, node_1 string, node_2 string, chunk_id long"))
    assert sorted((r.node_1, r.node_2, r["count"]) for r in found.collect()) == [("a", "b", 6), ("a", "c", 3), ("b", "a", 6), ("c", "a", 3)]


def test_cooccurrence_in_many_buckets_without_a_row_a_pair(spark, monkeypatch):
    import random
    from collections import Counter, defaultdict

    monkeypatch.setattr(meetings, "BUCKET_EDGES", 40)
    monkeypatch.setattr(meetings, "LEAST_EDGES", 1)
    draw = random.Random(3)
    maybe = lambda x: None if draw.random() < 0.03 else x
    rows = [(maybe(draw.randrange(3)), maybe(draw.choice("abcdeü")), maybe(draw.choice("ABCDa")), maybe(draw.randrange(150))) for _ in range(600)]
    count, chunks = Counter(), defaultdict(set)
    seen = [(x, c, n) for x, p, q, c in rows for n in (p, q) if None not in (x, c, n)]
    for x, c, n in seen:
        for _, d, m in seen:
            if c == d and n != m:
                count[x, n, m] += 1
                chunks[x, n, m].add(str(c))
    edges = spark.createDataFrame(rows, "context_id int, node_1 string, node_2 string, chunk_id long")
    ensure_checkpoint_dir(spark)
    folder = str(spark.sparkContext._jsc.sc().getCheckpointDir().get()).removeprefix("file:")
    before = sum(f.startswith("stored-") for f in os.listdir(folder))
    for least in (1, 2, 9):
        found = graph.cooccurring(edges, least)
        assert found.schema["context_id"].dataType.simpleString() == "int"
        got = {(r.context_id, r.node_1, r.node_2): (r["count"], r.chunk_ids) for r in found.collect()}
        assert got == {k: (n, sorted(chunks[k])) for k, n in count.items() if n > least}
    # Each result is one table; what led to it is removed.
    assert sum(f.startswith("stored-") for f in os.listdir(folder)) - before == 3
    # Pairs meet inside tasks: a join would write a row for each to disk.
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert graph.cooccurring(edges.where("chunk_id < 0")).count() == graph.cooccurring(edges, 10**6).count() == 0


def test_meetings_in_blocks(monkeypatch):
    import numpy as np
    import pyarrow as pa

    edges = pa.Table.from_pylist([{"context_id": str(i % 2), "chunk_id": str(i % 3), "node_1": f"a{i % 7}", "node_2": f"b{i}"} for i in range(60)], schema=meetings.EDGE)
    whole = list(meetings.Met(edges).blocks())
    monkeypatch.setattr(meetings, "HELD_PAIRS", 50)
    parts = list(meetings.Met(edges).blocks())
    assert len(whole) == 1 < len(parts) and all((np.concatenate([p[i] for p in parts]) == whole[0][i]).all() for i in range(3))
    numbers = np.array([0, 0, 3, 300, 2**60], np.uint64)
    assert (meetings.read(meetings.written(numbers)) == numbers).all() and len(meetings.read(meetings.written(numbers[:0]))) == 0
    assert meetings._among(np.array([1, 3, 2**24 + 3], np.uint64), numbers).tolist() == [False, True, False]


def test_meetings_in_turns(spark, monkeypatch):
    import random

    draw = random.Random(4)
    rows = [(draw.randrange(3), draw.choice("abcdef"), draw.choice("ABCD"), draw.randrange(60)) for _ in range(400)]
    edges = spark.createDataFrame(rows, "context_id int, node_1 string, node_2 string, chunk_id long")
    whole = {tuple(map(str, r)) for r in graph.cooccurring(edges).collect()}
    monkeypatch.setattr(meetings, "TURN_EDGES", 100)
    monkeypatch.setattr(meetings, "TURNS", 3)
    monkeypatch.setattr(meetings, "BUCKET_EDGES", 50)
    turns = []
    monkeypatch.setattr(meetings, "in_turn", lambda parts, plain=meetings.in_turn: plain(turns.append(p) or p for p in parts))
    assert {tuple(map(str, r)) for r in graph.cooccurring(edges).collect()} == whole and len(whole) > 50 and len(turns) == 3


def test_edges_are_stored_in_few_bytes():
    import random

    import pyarrow as pa

    draw = random.Random(6)
    rows = [{"context_id": draw.choice("ARN"), "chunk_id": str(draw.randrange(5_000)), "node_1": f"P{draw.randrange(1_000_000)}", "node_2": f"S{draw.randrange(60_000)}"} for _ in range(20_000)]
    edges = pa.Table.from_pylist(rows, schema=meetings.EDGE).sort_by("chunk_id").combine_chunks()
    blob = meetings._blob(edges)
    # The digits' own content is near 5 bytes an edge; offsets of four bytes a value took it to 17.
    assert len(blob) < 8 * len(rows) and meetings.unpacked([blob], meetings.EDGE).equals(edges)
    odd = pa.Table.from_pylist([dict(zip(meetings.EDGE.names, r, strict=True)) for r in [("a", "1", None, "é"), ("a", "1", None, ""), ("b", None, "q", "z")] + [(None,) * 4] * 3], schema=meetings.EDGE)
    for some in (odd, odd.slice(1, 2), odd.slice(3), odd.slice(0, 0)):
        assert meetings.unpacked([meetings._blob(some)], meetings.EDGE).to_pylist() == some.to_pylist()


def test_best_scores_stream_items_past_the_questions(spark, monkeypatch):
    import random
    from collections import defaultdict

    from quarrygraph.operators import dense, retrieval

    monkeypatch.setattr(dense, "BLOCK_QUERIES", 3)
    draw = random.Random(5)
    vectors = [[draw.gauss(0, 1) for _ in range(4)] for _ in range(12)] + [None, [0.0] * 4, [1.0, None, 0.0, 0.0]]
    items = spark.createDataFrame([(i, f"c{i % 3}", draw.choice(vectors), draw.choice(vectors)) for i in range(90)], "chunk_id long, context_id string, embedding array<double>, title_embedding array<double>")
    queries = spark.createDataFrame([(q, vectors[q]) for q in range(5)] + [(9, None)], "query_id long, q array<double>")
    asked = spark.createDataFrame([(q, f"c{c}") for q in (0, 1, 2, 3, 4, 9) for c in range(4) if (q + c) % 4], "query_id long, context_id string")
    signals = (("embedding", 0.7), ("title_embedding", 0.3))
    got = defaultdict(list)
    found = dense.best_scores(asked, items, queries, 5, signals, 1e-9)
    for r in found.collect():
        got[r.query_id, r.context_id].append(r.score)
    score = retrieval.chunk_score(F.col("embedding"), F.col("title_embedding"), F.col("q"), 0.3, True)
    want = defaultdict(list)
    for r in asked.join(items, "context_id").join(queries, "query_id").select("query_id", "context_id", score.alias("score")).collect():
        want[r.query_id, r.context_id].append(r.score)
    last_null = lambda x: (x is None, -(x or 0))
    assert len(want) > 10 and {k: sorted(v, key=last_null) for k, v in got.items()} == {k: sorted(v, key=last_null)[:5] for k, v in want.items()}
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["definition_chunks", "evidence"])
def test_vectors_of_chunks_are_not_shuffled(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning(chunk_id" in line or "Exchange hashpartitioning(u#" in line and "v#" not in line]
    assert not dealt


def test_token_f1(spark):
    from collections import Counter

    pairs = [("red big dog", "big dog"), (None, "x"), ("yes it is", "yes"), ("no", "no one"), ("Yes.", "yes"), ("noanswer", "an answer"), ("a a b", "a b b c"), ("the", "a"), ("x", None), ("w w w", "w w")]
    rows = spark.createDataFrame([(i, p, g) for i, (p, g) in enumerate(pairs)], "k long, p string, g string")
    normal = {r.k: (r.p, r.g) for r in rows.select("k", *[text.normalize_answer(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in "pg"]).collect()}
    got = {r.k: (r.f1, r.precision, r.recall) for r in evaluate.token_scores(rows, ["k"], "p", "g").collect()}
    for k, (p, g) in normal.items():
        same = sum((Counter(p.split()) & Counter(g.split())).values())
        if same == 0 or (p != g and {p, g} & {"yes", "no", "noanswer"}):
            assert got[k] == (0.0, 0.0, 0.0)
        else:
            precision, recall = same / len(p.split()), same / len(g.split())
            assert got[k] == pytest.approx((2 * precision * recall / (precision + recall), precision, recall))
    assert got[0][0] == pytest.approx(0.8) and got[2][0] == got[3][0] == 0.0 and got[4][0] == 1.0


def test_hybrid_edges(spark):
    e = spark.createDataFrame([("b", "a", None, 1, None, 2), ("a", "b", "x", 2, "later", 3), ("c", "c", "x", 3, "self", 1)], "node_1 string, node_2 string, context_id string, chunk_id long, edge string, ord long")
    i = spark.createDataFrame([("a", "b", "y", "7, 8", 0.5), ("b", "d", "y", "9", 0.25)], "node_1 string, node_2 string, context_id string, chunk_id string, implicit_score double")
    got = {(r.u, r.v): (r.chunk_ids, r.context_ids, r.relation, r.implicit_score, r.is_explicit) for r in graph.hybrid_edges(e, i).collect()}
    assert got[("a", "b")] == (["1", "2", "7", "8"], ["-1", "x", "y"], None, 0.5, True)
    assert got[("c", "c")][2:] == ("self", None, True) and got[("b", "d")][2:] == ("co-occurs with", 0.25, False)


def test_context_edges_are_the_hybrid_edges_of_a_context(spark, monkeypatch):
    import random

    draw = random.Random(8)
    maybe = lambda x: None if draw.random() < 0.05 else x
    node = lambda: maybe(draw.choice("abcdeü"))
    e = spark.createDataFrame([(node(), node(), maybe(draw.choice("xy")), n, "r", n) for n in range(60)], "node_1 string, node_2 string, context_id string, chunk_id long, edge string, ord long")
    i = spark.createDataFrame([(node(), draw.choice("defg"), draw.choice("xyz"), "7", maybe(draw.random())) for _ in range(60)], "node_1 string, node_2 string, context_id string, chunk_id string, implicit_score double")
    monkeypatch.setattr(pairs, "BUCKET_PAIRS", 20)
    for context in ("x", "z", "-1", "none"):
        both = graph.adjacency(graph.hybrid_edges(e, i).where(F.array_contains("context_ids", context))).select("u", "v", "is_explicit", "implicit_score")
        got = pairs.context_adjacency(e, i, context)
        assert got.schema.simpleString() == both.schema.simpleString()
        order = lambda rows: sorted(map(tuple, rows), key=str)
        assert order(got.collect()) == order(both.collect()) and (context == "none") == (not got.count())
    empty = pairs.context_adjacency(e.limit(0), i.limit(0), "x")
    assert empty.count() == 0


def test_expanding_shuffles_no_row_an_edge(spark):
    plan = QUERIES["expand_neighbors"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Exchange hashpartitioning(u#" in line and "v#" in line.split("Exchange")[1]]
    assert plan.count("MapInArrow") == 1


def test_containment_and_links(spark):
    import random

    import numpy as np

    from quarrygraph.operators import dense, lexical

    rng = random.Random(5)
    words = ["art", "cart", "a", "über", "new york", "x-1", "the"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 12))) for _ in range(60)]
    phrases = ["art", "Cart a", "new york the", "rt", "x", "", "k the a", "über", "york", "1 THE", None]
    found = lexical.containment(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), spark.createDataFrame(list(enumerate(phrases)), "phrase_id long, phrase string"))
    assert sorted((r.id, r.phrase_id) for r in found.collect()) == sorted((i, j) for i, t in enumerate(texts) for j, p in enumerate(phrases) if p and p.lower() in t)
    gen = np.random.default_rng(1)
    vectors = gen.normal(size=(80, 6))
    rows = spark.createDataFrame([(i, "ab"[i % 2], vectors[i].tolist() if i else None, 0.5, i % 3 if i % 5 == 0 else None) for i in range(80)], "id long, block string, vector array<double>, radius double, g int")
    links = {(min(r.src, r.dst), max(r.src, r.dst)) for r in dense.close_links(rows, ["block"], apart="g").collect()}
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = {(i, j) for i in range(1, 80) for j in range(i + 1, 80) if i % 2 == j % 2 and 1 - unit[i] @ unit[j] < 0.5 and not (i % 5 == j % 5 == 0 and i % 3 != j % 3)}

    def classes(pairs):
        of = list(range(80))
        for _ in range(80):
            for a, b in pairs:
                of[a] = of[b] = min(of[a], of[b])
        return of

    assert links <= near and classes(links) == classes(near)
    old, dense.CHUNK = dense.CHUNK, 7
    try:
        assert classes({(r.src, r.dst) for r in dense.close_links(rows, ["block"], apart="g").collect()}) == classes(near)
    finally:
        dense.CHUNK = old


def test_top_k_over_blocks(spark):
    import numpy as np

    from quarrygraph.operators import dense

    v = np.random.default_rng(2).normal(size=(50, 4))
    v[3] = v[4] = v[5]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(50, None)], "id long, v array<double>")
    old, dense.BLOCK_QUERIES = dense.BLOCK_QUERIES, 3
    try:
        got = sorted((r.query_id, r.id, r["rank"]) for r in dense.dense_top_k(df, df.where("id % 5 = 0").withColumnRenamed("id", "query_id"), 4, (("v", "v", 1.0),)).collect())
    finally:
        dense.BLOCK_QUERIES = old
    u = np.vstack([v / np.linalg.norm(v, axis=1, keepdims=True), np.zeros(4)])
    want = []
    for q in range(0, 51, 5):
        order = sorted(range(51), key=lambda i: (-round(float(u[q] @ u[i]), 6), i))[:4]
        want += [(q, i, n) for n, i in enumerate(order, 1)]
    assert got == sorted(want)


def test_resolution_chain(spark):
    """A junior and a senior are apart, but a plain name between them joins both."""
    from quarrygraph.operators import resolution

    rows = [(1, "c", "Ed Wood Jr.", "Person", ["Eddie"], [1.0, 0.0]), (2, "c", "Ed Wood Sr.", "Person", None, [1.0, 0.01]), (3, "d", "Ed Wood Jr.", "Person", None, [1.0, 0.0]), (4, "d", "Ed Wood", "Person", None, [1.0, 0.005]),
            (5, "d", "Ed Wood Sr.", "Person", None, [1.0, 0.01]), (6, "c", " Ed Wood Jr. ", "Person", None, [0.0, 1.0]), (7, "c", None, "Person", None, [0.0, 1.0])]
    ddl = "ord long, context_id string, entity string, category string, synonyms array<string>, vector array<double>"
    got = {r.ord: (r.standard_entity, r.cluster_id) for r in resolution.standardize_entities(spark.createDataFrame(rows, ddl)).collect()}
    assert got[1] == got[6] == ("Ed Wood Jr.", 0) and got[2] == ("Ed Wood Sr.", 1) and {got[3], got[4], got[5]} == {("Ed Wood Jr.", 0)} and got[7] == (None, -1)
    from quarrygraph.operators.providers import hashing_embedding

    embedded = resolution.standardize_entities(spark.createDataFrame(rows, ddl), hashing_embedding(64))
    assert embedded.count() == 7


def test_extraction(spark):
    from quarrygraph.operators import extraction

    chunks = spark.createDataFrame([("0", 1, "Ann met Bob. She left."), ("0", 2, "nothing")], "context_id string, chunk_id long, text string")
    solved = extraction.resolve_coreferences(chunks, lambda r: "Ann met Bob. Ann left." if r["chunk_id"] == 1 else None)
    assert [r.resolved_text for r in solved.orderBy("chunk_id").collect()] == ["Ann met Bob. Ann left.", "nothing"]
    reply = '```json\n[{"entity": "Ann", "category": "Person", "description": "d", "synonyms": ["A"]} {"entity": "Bob", "category": "Person"}]\n```'
    found = extraction.extract_concepts(solved, lambda r: reply if r["chunk_id"] == 1 else "no")
    assert {(r.chunk_id, r.entity, tuple(r.synonyms or ())) for r in found.collect()} == {(1, "Ann", ("A",)), (1, "Bob", ())}
    mentions = found.withColumn("standard_entity", F.col("entity")).withColumn("ord", F.monotonically_increasing_id())
    edges = extraction.extract_relations(solved, mentions, lambda r: '[{"node_1": "Ann", "node_2": "Bob", "edge": "met"}, {"node_1": " ", "node_2": "Bob"}]')
    assert [tuple(r) for r in edges.collect()] == [("0", "Ann", "Bob", "met", 1)]
    kinds = extraction.question_kind(spark.createDataFrame([("q",), ("r",)], "question string"), lambda r: "it is Relational" if r["question"] == "q" else "?")
    assert {r.question: r.kind for r in kinds.collect()} == {"q": "Relational", "r": "Factual"}


def test_solve(spark):
    from quarrygraph.operators import engine

    edges = spark.createDataFrame([("Ann", "Bob", ["1"], ["x"], "met", None, True), ("Bob", "Cid", ["2"], ["x"], "met", None, True)], "u string, v string, chunk_ids array<string>, context_ids array<string>, relation string, implicit_score double, is_explicit boolean")
    chunks = spark.createDataFrame([(1, "x", "Ann met Bob", [1.0, 0.0]), (2, "x", "Bob met Cid", [0.9, 0.1]), (3, "y", "Dan sings", [0.0, 1.0])], "chunk_id long, context_id string, text string, embedding array<double>")
    entities = spark.createDataFrame([(1, "x", "Ann", ["Ann"], "Ann a person", [1.0, 0.0], None, "a person", "Person", ["A."]), (2, "x", "Bob", ["Bob"], "Bob", [0.8, 0.2], None, "", "Person", [])], "id long, context_id string, node string, names array<string>, text string, name_vector array<double>, desc_vector array<double>, description string, category string, synonyms array<string>")
    ddl = "query_id long, text string, context_id string, q array<double>, name_vector array<double>, desc_vector array<double>, probs array<double>, gold_answer string"
    questions = spark.createDataFrame([(7, "whom did Ann meet", "x", [1.0, 0.0], [1.0, 0.0], None, [0.1, 0.8, 0.1], "Bob")], ddl)
    said = lambda r: "Thought. Final Answer: Bob" if "[Ref 1] Ann met Bob" in r["prompt"] else None
    full = engine.solve(questions, entities, edges, chunks, call=said).first()
    assert (full.answer, full.strategy) == ("Bob", "(Reasoning, P=0.86) -> Agent-Hop-1")
    assert "Ann: a person, [Category: Person], [Synonyms: A.]" in full.prompt
    assert engine.solve(questions, entities, edges, chunks, mode="vector_only", call=said).first().strategy == "Vector-RAG"
    assert "-> Agent-Hop" in engine.solve(questions, entities, edges, chunks, mode="explicit_only", scope="local").first().strategy
    lost = engine.solve(questions, entities.limit(0), edges, chunks).first()
    assert (lost.answer, lost.strategy) == (engine.NO_SEEDS, "No-Seeds")
    elsewhere = questions.withColumn("context_id", F.lit("y"))
    local = engine.solve(elsewhere, entities, edges, chunks, scope="local").first()
    assert "->" not in local.strategy and "Dan sings" in local.prompt
    table = engine.results(questions, engine.solve(questions, entities, edges, chunks, call=said)).first()
    assert (table.question, table.gold_answer, table.pred_answer) == ("whom did Ann meet", "Bob", "Bob")
    naive = engine.naive_answers(questions, chunks, k=2).first()
    assert naive.references == "[Ref 1] Ann met Bob\n[Ref 2] Bob met Cid" and naive.strategy == "Naive-Vector"

    def fails(row):
        raise OSError("down")

    direct = engine.direct_answers(questions, fails, retries=1).first()
    assert direct.pred_answer.startswith("ERROR: OSError") and direct.strategy == "error"


def test_sources(spark, tmp_path):
    import numpy as np

    from quarrygraph.sources import corpora

    spark.range(3).write.parquet(str(tmp_path / "p"))
    corpora.write_delimited(spark.range(2), str(tmp_path / "c.csv"), "id")
    assert corpora.first_existing(spark, str(tmp_path / "none"), str(tmp_path / "c.csv"), str(tmp_path / "p")).count() == 2
    assert corpora.first_existing(spark, str(tmp_path / "p")).count() == 3 and corpora.optional(spark, str(tmp_path / "no.csv"), "a string").count() == 0
    with pytest.raises(FileNotFoundError):
        corpora.first_existing(spark, str(tmp_path / "none"))
    docs = spark.createDataFrame([("a\nb\rc", {"title": "T"})], "page_content string, metadata map<string,string>")
    row = corpora.documents_to_rows(docs).first()
    assert row.text == "a b c" and row.metadata == {"title": "T"} and len(row.chunk_id) == 32
    corpora.write_results(spark.createDataFrame([(2, "b"), (1, "a")], "row_id long, question string"), str(tmp_path / "r"))
    assert [r.question for r in corpora.read_delimited(spark, str(tmp_path / "r")).collect()] == ["a", "b"]
    corpora.write_model(spark, {"w1": np.arange(6.0).reshape(2, 3), "b1": [1.0]}, str(tmp_path / "m"))
    back = corpora.read_model(spark, str(tmp_path / "m"))
    assert back["w1"].tolist() == [[0, 1, 2], [3, 4, 5]] and back["b1"].tolist() == [1.0]
    (tmp_path / "bad.csv").write_text("a|b\n1|2\n3\n4|5|6\n")
    assert corpora.read_delimited(spark, str(tmp_path / "bad.csv"), "a long, b long", tolerant=True).count() == 1


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (200, 200), (102, 100)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[102] == got[101] == 100 and got[200] == 200
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


@pytest.fixture(scope="module")
def db():
    made = duckdb.connect()
    for t in TABLES:
        made.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return made


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_oracle(spark, db, name):
    """Every registered query has a statement and gives its rows."""
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = db.execute(f"""SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({ORACLE_SQL[name]})""").fetchall()

    def plain(rows):
        value = lambda v: round(float(v), 5) + 0.0 if v.__class__.__name__ in ("Decimal", "float") else v
        return sorted(repr(tuple(map(value, r))) for r in rows)

    assert plain(df.select(*columns).collect()) == plain(want)


def test_corpora(spark, tmp_path):
    import json

    from quarrygraph.functions import parsing
    from quarrygraph.sources import corpora

    (tmp_path / "a.json").write_text(json.dumps([
        {"question": "q0", "answer": " x ", "context": [["T", ["One. ", "Two."]], ["T", ["again"]], ["bad"]]},
        {"question": "q1", "answer": "y", "context": [["U", ["Three."]]]},
    ]))
    items = corpora.read_items(spark, str(tmp_path / "a.json"), corpora.PAIRS_DDL)
    chunks = corpora.number_chunks(corpora.paired_paragraphs(items), parsing.splitter(3, 0)).orderBy("chunk_id").collect()
    assert [(r.context_id, r.chunk_id, r.text) for r in chunks] == [(0, 0, "T information: One."), (0, 1, "T information: Two."), (1, 2, "U information: Three.")]
    assert [tuple(r) for r in corpora.qa_pairs(items).orderBy("context_id").collect()] == [("q0", "x", 0), ("q1", "y", 1)]
    (tmp_path / "b.json").write_text(json.dumps([{"question": "q", "answer": "a", "question_decomposition": [{"answer": "b"}, {"answer": "c"}], "paragraphs": [{"title": "T"}]}]))
    items = corpora.read_items(spark, str(tmp_path / "b.json"), corpora.PARAGRAPHS_DDL)
    assert corpora.qa_pairs(items).first()["answer"] == "c" and corpora.listed_paragraphs(items).first()["text"] == ""
    (tmp_path / "c.json").write_text(json.dumps({"Questions": [{"RawQuestion": "q", "Parses": [{"Answers": [{"EntityName": "B"}, {"EntityName": None, "AnswerArgument": "A"}]}]}]}))
    assert tuple(corpora.parsed_questions(spark, str(tmp_path / "c.json")).first()) == ("q", "A, B")
    df = spark.createDataFrame([(1, 'a "b"\nc|d', ["x"]), (2, "None", [])], "id long, t string, l array<string>")
    corpora.write_delimited(df, str(tmp_path / "d"), "id")
    assert [(r.id, r.t, r.l) for r in corpora.read_delimited(spark, str(tmp_path / "d")).orderBy("id").collect()] == [("1", 'a "b"\nc|d', '["x"]'), ("2", "None", "[]")]
    calls = []
    for _ in range(2):
        assert corpora.materialized(spark, str(tmp_path / "e"), lambda: calls.append(1) or spark.range(3)).count() == 3
    assert calls == [1]


def test_parsing():
    from quarrygraph.functions import parsing

    assert parsing.decide("Final Answer: **Yes, it is.**")["answer"] == "yes"
    assert parsing.decide("Final Answer: Norway.\n\nmore")["answer"] == "Norway"
    assert parsing.decide("Final Answer: not found", ["a", "b", "c", "d"]) == {"is_final": False, "answer": "", "relevant_nodes": [], "next_nodes": ["a", "b", "c"]}
    got = parsing.decide("Relevant Nodes: [Ada; 'Bob']\nNext Hop: [Ed Wod; NOWHERE XYZ]", ["Ed Wood", "Ada"])
    assert got["relevant_nodes"] == ["Ada", "Bob"] and got["next_nodes"] == ["Ed Wood"]
    assert parsing.repair_json('```json\n[{"a": 1} {"a": 2}]\n```') == [{"a": 1}, {"a": 2}]
    assert parsing.repair_json("{'a': 1}") == [{"a": 1}] and parsing.repair_json("no") is None and parsing.repair_json('[{"a": 1}, {"b": ') == [{"a": 1}]
    text = "one two three. four five six. seven eight"
    parts = parsing.split_text(text, 5, 0)
    assert " ".join(parts) == text and all(parsing.word_count(p) <= 5 for p in parts)
    assert parsing.split_text("a b c d e f", 3, 1) == ["a b c", "c d e", "e f"]


def test_persons(spark):
    from quarrygraph.operators.persons import generations_apart, merge_persons

    rows = [("0", 1, "Ed Wood", "Person", "Ed Wood"), ("0", 2, "Edward", "Person", "Edward"), ("0", 3, "Sir Ed Wood", "Person", "Sir Ed Wood"), ("1", 4, "Ed", "Person", "Ed"), ("0", 5, "Ed", "Place", "Ed")]
    got = {r.ord: r.standard for r in merge_persons(spark.createDataFrame(rows, "context_id string, ord int, entity string, category string, standard string")).collect()}
    assert got == {1: "Sir Ed Wood", 2: "Edward", 3: "Sir Ed Wood", 4: "Ed", 5: "Ed"}
    assert one(spark, generations_apart(F.lit("A Jr."), F.lit("A Sr"))) and not one(spark, generations_apart(F.lit("A Jr."), F.lit("A")))


def test_persons_with_a_common_beginning_do_not_all_meet(spark):
    from quarrygraph.operators.persons import candidates, merge_persons

    n = 30_000
    k = F.col("id")
    name = F.concat(F.lit("Personage "), F.lpad(k.cast("string"), 7, "0"), F.when(k % 10_000 == 7, " Lee Junior the Second of his Name").otherwise(""))
    long = spark.range(n).select(F.lit("0").alias("context_id"), k.alias("ord"), name.alias("entity"), F.lit("Person").alias("category"), name.alias("standard"))
    more = spark.createDataFrame([("0", n, "Lee Junior the Second", "Person", "Lee Junior the Second"), ("0", n + 1, "0029999", "Person", "0029999"), ("0", n + 2, "é", "Person", "é")], long.schema)
    got = {r.ord: r.standard for r in merge_persons(long.unionByName(more)).collect()}
    changed = {i: s for i, s in got.items() if s not in (f"Personage {i:07d}", f"Personage {i:07d} Lee Junior the Second of his Name")}
    assert changed == {n: "Personage 0020007 Lee Junior the Second of his Name", n + 1: "Personage 0029999", n + 2: "é"}
    # All pairs of the names are 900 million.
    people = long.select("context_id", "ord", text.clean_entity(F.col("entity")).alias("c"))
    assert candidates(people).count() < 20 * n


def test_retrieval(spark):
    from quarrygraph.operators import retrieval

    edges = spark.createDataFrame([("a", "b", ["1"], ["x"], True, None), ("b", "c", ["2"], ["x", "y"], True, None), ("c", "d", ["3"], ["y"], True, 0.5)], "u string, v string, chunk_ids array<string>, context_ids array<string>, is_explicit boolean, implicit_score double")
    chunks = spark.createDataFrame([(1, "x", [1.0, 0.0]), (2, "x", [0.8, 0.6]), (3, "y", [0.0, 1.0])], "chunk_id long, context_id string, embedding array<double>")
    queries = spark.createDataFrame([(7, [1.0, 0.0])], "query_id long, q array<double>")
    linked = spark.createDataFrame([(7, "a", 1), (7, "d", 2), (8, "zz", 1)], "query_id long, entity string, rank int")
    assert {(r.query_id, r.context_id, r.entity) for r in retrieval.route_contexts(linked, edges, chunks, queries).collect()} == {(7, "x", "a"), (8, None, "zz")}
    vectors = spark.createDataFrame([("b", [1.0, 0.0], None)], "node string, vec_entity array<double>, vec_desc array<double>")
    seeds, active = spark.createDataFrame([(7, "a")], "query_id long, node string"), spark.createDataFrame([(7, "x")], "query_id long, context_id string")
    walked = retrieval.walk(seeds, edges, vectors, queries, active, (0.15, 0.30, 0.55))
    assert [(r.hop, r.u, r.v, round(r.weight, 3)) for r in walked.orderBy("hop").collect()] == [(1, "a", "b", 0.395), (2, "b", "c", 0.275)]
    found = retrieval.evidence(walked.where("hop = 1"), seeds.union(spark.createDataFrame([(7, "b")], "query_id long, node string")), edges, chunks, queries, active)
    assert [(r.chunk_id, r.label, r["rank"]) for r in found.orderBy("rank").collect()] == [("1", "Path Evidence", 1), ("2", "Context", 2)]
    ranked = retrieval.fallback_rank(spark.createDataFrame([(7, 2, 3.0)], "query_id long, id long, score double"), spark.createDataFrame([(7, 1, 0.9), (7, 2, 0.5), (7, 3, 0.1)], "query_id long, id long, score double"))
    assert [(r.id, round(r.score, 4)) for r in ranked.orderBy("rank").collect()] == [(2, round(0.3 + 0.7 / 3, 4)), (1, round(0.7 * 2 / 3, 4)), (3, 0.0)]


def test_intents_and_providers(spark):
    import numpy as np

    from quarrygraph.operators import intents, providers

    f = intents.structure(F.lit("compare the size of A or the part of B"))
    assert [one(spark, c) for c in f.values()] == [2, 0, 2.0, 0.5]
    assert one(spark, intents.strategy(F.lit("(Relational, P=0.9) -> Agent-2"))) == "Agent-2" and one(spark, intents.intent_of(F.lit("(Relational, P=0.9)"))) == "Reasoning"
    w = {"w1": np.eye(2), "b1": np.zeros(2), "gamma": np.ones(2), "beta": np.zeros(2), "mean": np.zeros(2), "var": np.ones(2), "w2": np.eye(2), "b2": np.zeros(2)}
    assert abs(sum(one(spark, intents.network(w)(F.array(F.lit(1.0), F.lit(-3.0))))) - 1) < 1e-9
    rows = spark.createDataFrame([([float(i % 2), 1.0], i % 2) for i in range(40)], "features array<double>, label int")
    assert intents.train(rows).numClasses == 2
    rep = {r.label: r for r in intents.class_report(spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b")], "y string, p string"), "y", "p").collect()}
    assert rep["a"].recall == 0.5 and rep["a"].precision == 1.0 and rep["b"].precision == 0.5
    got = {r.id: (r.result, r.status) for r in providers.map_rows(spark.range(3), lambda r: {0: "x", 1: None}[int(r["id"])], retries=2, delay=0.01).collect()}
    assert got[0] == ("x", "ok") and got[1] == (None, "empty") and got[2][1].startswith("KeyError")
    assert abs(sum(x * x for x in one(spark, providers.hashing_embedding(16)(F.lit("a b c")))) - 1) < 1e-9


def test_mapping_of_tied_rows(spark, tmp_path):
    """Rows that the statement's order leaves tied: one of its permitted results, the same in any order of rows."""
    found = lambda d: sorted(map(tuple, QUERIES["mapping_left_default"](spark, str(d)).collect()))
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW orders AS SELECT * FROM '{sf}/orders.parquet'")
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{sf}/lineitem.parquet' QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey ORDER BY l_suppkey) = 1")
    assert found(sf) == sorted(con.sql(ORACLE_SQL["mapping_left_default"]).fetchall())
    rows = [(2, 7, 50, 99), (2, 7, 50, 77), (2, 7, 50, 100), (2, 6, 60, 1), (4, 1, 5, 8), (4, 1, 6, 9)]
    for name, order in (("a", rows), ("b", rows[::-1]), ("c", rows[1:] + rows[:1])):
        spark.createDataFrame(order, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long").coalesce(1).write.parquet(str(tmp_path / name / "lineitem.parquet"))
        orders = [(i, "OFP"[i % 3], "1-URGENT") for i in range(2, 7)]
        spark.createDataFrame(orders, "o_orderkey long, o_orderstatus string, o_orderpriority string").coalesce(1).write.parquet(str(tmp_path / name / "orders.parquet"))
        assert {r[0]: r[4:] for r in found(tmp_path / name)} == {2: ("2", -1), 3: ("77", 50), 4: ("9", 6), 5: ("4", -1), 6: ("6", -1)}
