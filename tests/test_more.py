"""Seeds, descriptors, collections, reports and searches that fail in part."""

import random

import pytest
from pyspark.sql import functions as F

from kgloom import queries, reports, session
from kgloom.model import Config, ValidationError, VectorDBError
from kgloom.operators import evaluate, paths, search, vectors
from kgloom.pipeline import Engine, ScriptedModel
from kgloom.sources.files import markdown
from kgloom.testbed import build, graph
from tests.hand import EX, SC, hand_graph


@pytest.fixture(scope="module")
def kg(spark):
    return hand_graph(spark)


ENCODER = vectors.HashingEncoder(16)


def test_limited(spark):
    assert session.limited(spark, lambda: 3, None) == (True, 3, None)
    ok, _, error = session.limited(spark, lambda: 1 / 0, 5)
    assert not ok and "ZeroDivisionError" in error
    ok, _, error = session.limited(spark, lambda: spark.range(10**13).agg(F.sum(F.col("id") % 7)).collect(), 2)
    assert not ok and error == "timeout after 2 s"


def test_keyword_search_in_part(kg, spark, monkeypatch):
    asked = spark.createDataFrame([("a", "lee"), ("b", "bob"), ("c", " ")], "query_id string, name string")
    found, errors = search.keyword_search_each(kg, asked)
    assert sorted((r["query_id"], r["entity_uri"]) for r in found.collect()) == [("a", EX + "a"), ("b", EX + "b")] and errors == {}
    plain = search.keyword_search

    def broken(kg, keywords, limit, **options):
        if any(r["query_id"] == "a" for r in keywords.collect()):
            raise RuntimeError("no")
        return plain(kg, keywords, limit, **options)

    monkeypatch.setattr(search, "keyword_search", broken)
    found, errors = search.keyword_search_each(kg, asked)
    assert [(r["query_id"], r["entity_uri"]) for r in found.collect()] == [("b", EX + "b")] and "no" in errors["a"] and len(errors) == 1


def _seeds(spark):
    return spark.createDataFrame([("q", EX + "a", "Ann Lee", 0.1, "Ann"), ("q", EX + "b", "Bob Ray", 0.2, "Bob"), ("q", EX + "b", "Bob Ray", 0.3, "Ray"), ("q", EX + "none", "none", 0.4, "None")], "question_id string, entity_uri string, label string, score double, entity_from string")


def test_by_seed(kg, spark, monkeypatch):
    templates = spark.createDataFrame([("q", "paper")], "question_id string, text string").select("question_id", ENCODER.encode(F.col("text")).alias("template"))
    relations = spark.createDataFrame([], "question_id string, relation_uri string")
    options = {"config": Config(absolute_prob_threshold=0.1), "max_hops": 1}
    found, errors = paths.by_seed(kg, _seeds(spark), templates, relations, ENCODER, **options)
    rows = {r["entity_from"]: r for r in found.collect()}
    assert errors == {} and set(rows) == {"Ann", "Bob", "Ray", "None"}
    assert rows["Ann"]["subgraph_count"] == len(rows["Ann"]["subgraphs"]) > 0 == rows["None"]["subgraph_count"]
    assert rows["Bob"]["subgraphs"] == rows["Ray"]["subgraphs"] and rows["Ann"]["seed_label"] == "Ann Lee" and rows["Ray"]["seed_score"] == 0.3
    plain = paths.subgraphs

    def broken(kg, seeds, *more, **options):
        if any(r["seed_uri"] == EX + "b" for r in seeds.collect()):
            raise RuntimeError("bad seed")
        return plain(kg, seeds, *more, **options)

    monkeypatch.setattr(paths, "subgraphs", broken)
    found, errors = paths.by_seed(kg, _seeds(spark), templates, relations, ENCODER, **options)
    assert set(errors) == {("q", EX + "b")} and sorted(r["entity_from"] for r in found.collect()) == ["Ann", "None"]


def test_descriptors_and_collections(kg, spark, tmp_path):
    folder = f"file://{tmp_path}"
    config = Config(collection_name="e", relation_collection_name="r", entity_descriptor=lambda uri, triples: f"thing with {len(triples)}", relation_descriptor=lambda uri, triples: 1 / 0)
    entities, relations = vectors.collections(kg, ENCODER, folder, config)
    told = {r["uri"]: r["description"] for r in entities.collect()}
    assert told[EX + "p1"] == "thing with 6" and told[EX + "a"] == "thing with 2"
    assert {r["uri"]: r["description"] for r in relations.collect()}[SC + "yearOfPublication"] == "year of publication"
    assert vectors.exists(spark, f"{folder}/e") and vectors.exists(spark, f"{folder}/r")
    spark.createDataFrame([(EX + "z", "a, \"z\""), (EX + "y", "  ")], "entity string, description string").coalesce(1).write.option("header", True).option("escape", '"').csv(f"{folder}/csv")
    made = vectors.collection_from_csv(spark, f"{folder}/csv", f"{folder}/made", ENCODER)
    assert [(r["id"], r["uri"], r["description"]) for r in made.collect()] == [("entity_0", EX + "z", 'a, "z"')]
    with pytest.raises(VectorDBError):
        vectors.collection_from_csv(spark, f"{folder}/csv", f"{folder}/made", ENCODER)
    assert vectors.collection_from_csv(spark, f"{folder}/csv", f"{folder}/made", ENCODER, overwrite=True).count() == 1


def test_backfill(kg, spark):
    held = vectors.compile_entities(kg, ENCODER, 1)
    golden = spark.createDataFrame([("1", [f"<{EX}p1>", "bad", f"{EX}a"]), ("2", [EX + "b"])], "id string, golden_entities array<string>")
    new, log = vectors.backfill(held, golden, "golden_entities", kg, ENCODER, first=1)
    assert {r["uri"]: r["status"] for r in log.collect()} == {EX + "p1": "updated", EX + "a": "added"}
    assert {r["uri"]: r["description"] for r in new.collect()} == {EX + "p1": "Paper: Graph Paths", EX + "a": "Person: Ann Lee"}
    with pytest.raises(ValidationError):
        vectors.backfill(held, golden.where("id = '3'"), "golden_entities", kg, ENCODER)


def test_schema_fallback_and_templates(kg, spark):
    terms = spark.createDataFrame([(SC + "Person", "entity", "a person"), (SC + "Paper", "entity", "a paper"), (SC + "cites", "relation", "cites a paper")], "uri string, kind string, description string")
    schema = vectors.compile_schema(terms, ENCODER)
    model = ScriptedModel({("sparql", "paper?"): f"SELECT ?x WHERE {{ ?x <{SC}cites> ?y }}"})
    engine = Engine(kg, None, None, ENCODER, model, Config(schema_top_k_entities=1), schema)
    assert engine.generate_sparql("paper?", [], [], [])[1] == [{"x": EX + "p2"}]
    assert f"<{SC}cites>" in model.calls[-1][1]["relations"]
    engine.templates({"1": "paper?"})
    assert SC + "Paper" in model.calls[-1][1]["entity_types"] and SC + "cites" in model.calls[-1][1]["relations"]
    seeds = _seeds(spark).withColumn("question_id", F.lit("1"))
    relations = spark.createDataFrame([("1", SC + "cites", "cites", "quotes")], "question_id string, relation_uri string, label string, relation_from string")
    engine.templates({"1": "paper?"}, seeds, relations)
    assert f"Ann Lee <{EX}a>" in model.calls[-1][1]["seeds"] and "quotes" in model.calls[-1][1]["relations"]
    Engine(kg, None, None, ENCODER, model, Config(use_schema_aware_templates=False), schema).templates({"1": "paper?"}, seeds, relations)
    assert set(model.calls[-1][1]) == {"question"}


def test_reports(spark):
    rows = [("1", "A", "correct_0", 1, 1, 1.0, 1.0, 1.0, True, None), ("2", "A", "wrong_1", 1, 0, 0.0, 0.0, 0.0, False, "MISSING_UNION"), ("3", "B", "wrong_0", 1, 0, 0.0, 0.0, 0.0, False, "MISSING_UNION"), ("4", "B", "correct_1", 1, 1, 1.0, 0.5, 0.6667, True, "CORRECT_EQUIVALENT")]
    states = spark.createDataFrame(rows, "question_id string, query_type string, state string, golden_count long, generated_count long, precision double, recall double, f1 double, correct boolean, failure_code string")
    found = {(r["query_type"], r["failure_code"]): (r["n"], r["share"], r["category"]) for r in evaluate.failure_histogram(states).collect()}
    assert found == {("A", "MISSING_UNION"): (1, 1.0, "Missing OR Logic"), ("B", "MISSING_UNION"): (1, 0.5, "Missing OR Logic"), ("B", "CORRECT_EQUIVALENT"): (1, 0.5, "Correct Equivalent"), ("ALL", "MISSING_UNION"): (2, 0.6667, "Missing OR Logic"), ("ALL", "CORRECT_EQUIVALENT"): (1, 0.3333, "Correct Equivalent")}
    one = reports.type_report(states, "A")
    assert "| A | 2 | 1 | 0 | 0 | 1 |" in one and "| 2 | wrong_1 |" in one and "| 3 |" not in one
    whole = reports.combined_report(states)
    assert "| ALL | 4 | 1 | 1 | 1 | 1 |" in whole and "Missing OR Logic" in whole and "| ALL | 4 | 0.5 |" in whole
    assert reports.summary_report(states).count("\n| ") == 4
    questions = spark.createDataFrame([("1", "A", ["<u>", "w"]), ("2", "B", ["v"])], "id string, query_type string, golden_entities array<string>")
    seeds = spark.createDataFrame([("1", "u"), ("1", "w"), ("2", "x")], "question_id string, entity_uri string")
    text = reports.pipeline_report({"seeds": seeds, "filtered_seeds": seeds.where("entity_uri = 'u'")}, questions)
    assert "| ALL | 2 | 3 | 1 |" in text and "| 3 | 2 | 1 |" in text
    cut = markdown("t", spark.range(5), 2)
    assert "Only the first 2 rows are shown." in cut and cut.count("\n| ") == 3 and "Only" not in markdown("t", spark.range(5))


def test_balanced_sample_takes_what_types_have(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice("aaaaab" if i % 3 else "c")) for i in range(60)] + [(99, "z")]
    found = evaluate.balanced_sample(spark.createDataFrame(rows, "id long, query_type string"), 10).collect()
    types = sorted({t for _, t in rows})
    want = []
    for i, t in enumerate(types):
        want += sorted(r for r, k in rows if k == t)[: 10 // len(types) + (i < 10 % len(types))]
    assert sorted(r["id"] for r in found) == sorted(want)


def test_stored_graph_equals_the_tables(spark):
    sf = queries.table and "/root/testdata/sf0.001"
    one, two = graph(spark, sf).triples, build(spark, sf).select(*graph(spark, sf).triples.columns)
    assert one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty()


def test_filter_seeds_word_ratio(spark):
    """The registered query against plain Python, on whole small tables."""
    from difflib import SequenceMatcher

    found = queries.QUERIES["filter_seeds_word_ratio"](spark, "/root/testdata/sf0.001").collect()
    rows = [r for r in queries._seeds(spark, "/root/testdata/sf0.001").collect() if r["entity_types"] != ["Literal"]]
    groups, want = {}, set()
    for r in rows:
        groups.setdefault((r["question_id"], r["entity_from"]), []).append(r)
    alike = lambda a, b: 1.0 if a in b or b in a else SequenceMatcher(None, b, a).ratio()
    exact = {(r["question_id"], r["entity_from"], r["entity_uri"]): r["fuzzy_score"] for r in found}
    for key, some in groups.items():
        for r in some:
            low = (r["label"].strip().lower(), r["entity_from"].strip().lower())
            if low[0] in low[1] or low[1] in low[0]:
                want.add((*key, r["entity_uri"]))
    tops = {k: max(v for (q, m, _), v in exact.items() if (q, m) == k) for k in {(q, m) for q, m, _ in exact}}
    assert all(0 <= v <= 1 for v in exact.values()) and exact.keys() <= {(r["question_id"], r["entity_from"], r["entity_uri"]) for r in rows}
    assert {k for k in groups} == set(tops) and all(tops[w[:2]] == 1.0 for w in want) and alike("a", "ab") == 1.0


@pytest.mark.parametrize("small", [0, 5, 100_000])
def test_components(spark, small):
    from kgloom.operators.components import connected_components

    rng = random.Random(9)
    pairs = [(rng.randrange(80), rng.randrange(80)) for _ in range(45)] + [(i, i + 1) for i in range(200, 230)] + [(7, 7), (None, 3)]
    root = {i: i for i in range(300)}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        if a is not None and a != b:
            root[find(a)] = find(b)
    linked = {x for a, b in pairs if a is not None and a != b for x in (a, b)}
    rows = spark.createDataFrame([(None if a is None else (a, "k"), (b, "k")) for a, b in pairs], "a struct<x: int, y: string>, b struct<x: int, y: string>")
    found = {r["node"]["x"]: r["root"]["x"] for r in connected_components(rows, "a", "b", session.checkpoint, small).collect()}
    assert found.keys() == linked
    groups = {}
    for i in linked:
        groups.setdefault(find(i), set()).add(i)
    got = {}
    for i, r in found.items():
        got.setdefault(r, set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups.values())) and all(r in g for r, g in got.items())
