"""Steps that must stay bounded on large tables, with the same results."""

import math

import pytest
from pyspark.sql import functions as F

from kgloom import queries, testbed
from kgloom.operators import evaluate, filters, merge, neighbors, vectors
from tests.hand import EX, hand_graph

SF = "/root/testdata/sf0.001"


def _distance(a, b):
    if a is None or b is None or len(a) != len(b) or None in a or None in b:
        return None
    unit = []
    for v in (a, b):
        norm = 0.0
        for x in v:
            norm += x * x
        if not norm:
            return None
        unit.append([x / math.sqrt(norm) for x in v])
    total = 0.0
    for x, y in zip(*unit, strict=True):
        total += x * y
    return 1 - total


@pytest.mark.parametrize("most", [20_000, 3])
def test_nearest_odd_vectors(spark, most, monkeypatch):
    held = [(f"v{i}", [float(i % 7) - 3, float(i % 5), 1.0]) for i in range(60)] + [(f"same{i}", [1.0, 2.0, 3.0]) for i in range(30)]
    held += [("zero", [0.0, 0.0, 0.0]), ("none", None), ("null", [1.0, None, 2.0]), ("short", [1.0, 2.0]), ("empty", []), (None, [1.0, 2.0, 3.0])]
    asked = [("a", [1.0, 2.0, 3.0]), ("b", [-3.0, 0.5, 1.0]), ("c", [0.0, 0.0, 0.0]), ("d", None), ("e", [2.0, 2.0]), ("f", [1.0, 2.0, 3.0]), ("g", [1.0, 2.0, 3.0, 4.0])]
    collection = spark.createDataFrame(held, "id string, embedding array<float>").repartition(5)
    question = spark.createDataFrame(asked, "query_id string, vector array<float>")
    want = set()
    for q, v in asked:
        near = sorted(((d, i is not None, i) for i, u in held if (d := _distance(u, v)) is not None), key=lambda x: (x[0], x[1], x[2] or ""))
        want |= {(i, q, d, k) for k, (d, _, i) in enumerate(near[:4], 1)}
    found = vectors.nearest(collection, question, 4, most=most)
    assert found.columns == ["id", "embedding", "query_id", "distance", "rank"]
    assert {(r["id"], r["query_id"], r["distance"], r["rank"]) for r in found.collect()} == want


def test_nearest_multiplies_blocks(spark):
    """A product of a pair of vectors as a column is what took hours."""
    e = queries.table(spark, SF, "embeddings")
    plan = queries.QUERIES["knn_cosine"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "NestedLoop" not in plan and "Cartesian" not in plan
    assert queries.QUERIES["knn_cosine"](spark, SF).count() == 5 * e.where("vec_id % 20 = 0").count()


def test_coverage_of_long_lists(spark):
    lists = [(["<a>", "a", "b", None, "c"], ["a", " b "], [None, "c"]), ([], None, ["a"]), (None, ["a"], []), (["a", "a"], ["a", "a"], None)]
    rows = spark.createDataFrame(lists, "golden array<string>, b array<string>, a array<string>")
    found = filters.coverage_stats(rows, "golden", "b", "a").collect()
    assert [(r["covered_before"], r["covered_after"], r["lost"], r["verdict"]) for r in found] == [(3, 1, 2, "FAIL"), (0, 0, 0, "PASS"), (0, 0, 0, "PASS"), (2, 0, 2, "FAIL")]
    n = 100_000  # of which each with each would be 10^10 comparisons
    long = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda x: F.concat(F.lit("<"), x.cast("string"), F.lit(">"))).alias("golden"), F.transform(F.sequence(F.lit(2), F.lit(n), F.lit(2)), lambda x: x.cast("string")).alias("b"), F.array(F.lit("7")).alias("a"))
    r = filters.coverage_stats(long, "golden", "b", "a").head()
    assert (r["n_golden"], r["covered_before"], r["covered_after"], r["lost"], r["verdict"]) == (n, n // 2, 1, n // 2 - 1, "FAIL")


def test_lists_of_merged_graphs_are_streamed(spark):
    held = [(q, c, f"s{i % 7}", f"o{i:05d}", q * 10) for q, c, n in ((1, "a", 25_000), (1, "b", 1), (2, "a", 3), (2, "c", 1)) for i in range(n)]
    rows = spark.createDataFrame(held, "q int, c string, s string, o string, x int").repartition(4)
    found = merge._listed(rows, ["q", "c"], ["s", "o"], "items", ["x"])
    want = {}
    for q, c, s, o, x in held:
        want.setdefault((q, c, x), []).append((s, o))
    assert {(r["q"], r["c"], r["x"]): [tuple(i) for i in r["items"]] for r in found.collect()} == {k: sorted(v) for k, v in want.items()}
    plan = merge.merged(spark.createDataFrame([("q", "g", [("a", "p", "b")], [("a", "A", True)], 0.5, 1)], "question_id string, graph_id string, triplets array<struct<s: string, p: string, o: string>>, path array<struct<uri: string, label: string, is_node: boolean>>, probability double, path_depth int"))
    assert "collect_list" not in plan._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r["triples"][0]) for r in plan.collect()] == [("A", "a", "p", "p", "b", "b")]


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_row_sets_are_compared_without_a_join(spark):
    golden = spark.createDataFrame([("1", "a"), ("1", "a"), ("1", "b"), ("1", None), ("2", "a")], "question_id string, row string")
    generated = spark.createDataFrame([("1", "a"), ("1", "c"), ("1", None), ("3", "a")], "question_id string, row string")
    status = spark.createDataFrame([(q, True, True) for q in "1234"], "question_id string, golden_ok boolean, generated_ok boolean")
    found = evaluate.compare_rows(golden, generated, status)
    assert {r["question_id"]: (r["state"], r["golden_count"], r["generated_count"], r["precision"], r["exact_match"]) for r in found.collect()} == {
        "1": ("correct_1", 3, 3, 0.3333, False), "2": ("wrong_1", 1, 0, 0.0, None), "3": ("correct_0", 0, 1, 1.0, None), "4": ("correct_0", 0, 0, 1.0, None)}
    assert "FullOuter" not in _plan(found)


def test_graph_tells_keys_apart_before_texts(spark):
    rows = testbed.build(spark, SF)
    line = queries.table(spark, SF, "lineitem")
    for p, keys in (("containsPart", ("l_orderkey", "l_partkey")), ("suppliedBy", ("l_partkey", "l_suppkey"))):
        part = rows.where(F.col("p") == testbed.SC + p)
        assert part.count() == part.distinct().count() == line.select(*keys).distinct().count()
        assert f"Aggregate [{keys[0]}#" in _plan(part)


def test_descriptions_leave_other_triples_in_place(spark):
    kg = hand_graph(spark)
    lone = spark.createDataFrame([(EX + "z", "http://other/p", "v", "literal", None, None)], "s string, p string, o string, o_kind string, o_datatype string, o_lang string")
    kg = type(kg)(kg.triples.unionByName(lone))
    uris = spark.createDataFrame([(EX + "z",), (EX + "a",), (EX + "none",)], "uri string")
    found = neighbors.relation_metadata(kg, uris)
    assert sorted((r["relation"], r["type"] is None, r["labels"], r["comments"]) for r in found.collect()) == [(EX + "a", False, ["Ann Lee"], []), (EX + "z", True, [], [])]
    described = neighbors.entity_descriptions(kg, uris)
    assert dict(map(tuple, described.collect())) == {EX + "a": "Person: Ann Lee", EX + "z": "Entity: z", EX + "none": "none"}
    assert "p#" in _plan(found) and all(" IN (" in _plan(x) or "INSET" in _plan(x) for x in (found, described))
