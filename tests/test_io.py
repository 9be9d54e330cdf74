import json
import os

import pytest
from pyspark.sql import functions as F

from kgloom.model import Config, ConfigurationError, GraphError, PipelineError, SearchMode, SPARQLGenerationError, ValidationError
from kgloom.operators import evaluate, filters
from kgloom.sources import files, rdf
from kgloom.streaming import load_continuously
from tests.hand import LINES, hand_graph


def test_ntriples_round_trip(spark, tmp_path):
    kg = hand_graph(spark)
    assert kg.triples.count() == 15
    rdf.write_ntriples(kg, str(tmp_path / "nt"))
    again = rdf.read_ntriples(spark, str(tmp_path / "nt"))
    key = lambda g: sorted(map(repr, g.triples.collect()))
    assert key(again) == key(kg)
    rdf.write_parquet(kg, str(tmp_path / "pq"))
    back = rdf.read_parquet(spark, str(tmp_path / "pq"))
    assert key(back) == key(kg)
    plan = back.triples.where(F.col("p") == "x")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(p" in plan


def test_streaming(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.nt").write_text(LINES)
    load_continuously(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    (tmp_path / "in" / "b.nt").write_text('<http://x/a> <http://x/b> "c" .\n')
    load_continuously(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 16


def test_json(spark, tmp_path):
    rows = [{"id": "1", "query_type": "COUNT", "question": {"1": "", "2": "zwei"}, "answer": [{"a": {"type": "uri", "value": "x"}}]}, {"id": "2", "query_type": "UNION", "question": {"1": "eins"}}]
    (tmp_path / "l.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n\n")
    (tmp_path / "w.json").write_text(json.dumps(rows, indent=1))
    (tmp_path / "e.json").write_text("")
    from kgloom.functions.text import question_text

    for name in ("l.jsonl", "w.json"):
        found = files.read_json_or_jsonl(spark, str(tmp_path / name))
        assert sorted(r[0] for r in found.select(question_text(F.col("question"))).collect()) == ["eins", "zwei"]
    assert files.read_jsonl(spark, str(tmp_path / "l.jsonl")).count() == 2
    assert files.read_json_or_jsonl(spark, str(tmp_path / "e.json")).count() == 0
    out = str(tmp_path / "out")
    first = files.read_jsonl(spark, str(tmp_path / "l.jsonl")).select("id", "query_type")
    assert files.append_new(first.where("id = '1'"), out).count() == 1
    with open(os.path.join(out, "part-99999-bad.json"), "w") as f:
        f.write('{"id": broken\n')
    assert [r["id"] for r in files.append_new(first, out).collect()] == ["2"]
    assert files.append_new(first, out).count() == 0


def test_benchmark_files(spark, tmp_path):
    q = {"questions": [{"id": "Q1", "query_type": "BOOLEAN", "question": {"string": "a?"}, "paraphrased_question": {"string": "b?"}, "query": {"sparql": "ASK {}"}, "entities": ["<x>"], "relations": []}, {"id": "Q2", "query_type": "COUNT", "question": {"string": "c"}, "paraphrased_question": {"string": "d"}, "query": {"sparql": "no query"}, "entities": [], "relations": []}]}
    a = {"answers": [{"id": "Q1", "answer": {"head": {}, "boolean": True}}, {"id": "Q2", "answer": {"head": {}, "results": {"bindings": [{"n": {"type": "literal", "value": "3"}}]}}}]}
    (tmp_path / "q.json").write_text(json.dumps(q))
    (tmp_path / "a.json").write_text(json.dumps(a))
    found = {r["id"]: r for r in files.read_benchmark(spark, str(tmp_path / "q.json"), str(tmp_path / "a.json")).collect()}
    assert found["Q1"]["answer"][0]["boolean"]["value"] == "true" and found["Q2"]["answer"][0]["n"]["value"] == "3" and found["Q1"]["question"]["2"] == "b?"
    rows = files.read_benchmark(spark, str(tmp_path / "q.json"), str(tmp_path / "a.json"))
    assert [r["id"] for r in evaluate.with_valid_syntax(rows).collect()] == ["Q1"]
    assert [r["id"] for r in evaluate.first_sample(rows, 5).collect()] == ["Q1"]


def test_csv_and_reports(spark, tmp_path):
    rows = spark.createDataFrame([("http://a", 3, 'say "x", y')], "entity string, degree long, description string")
    files.write_csv(rows, str(tmp_path / "c"))
    assert files.read_entities(spark, str(tmp_path / "c"), True).collect() == rows.collect()
    with pytest.raises(ValidationError):
        files.read_relations(spark, str(tmp_path / "c"))
    log = spark.createDataFrame([("http://a", "d", "added")], "uri string, description string, status string")
    assert "entity_uri" in spark.read.option("header", True).csv(files.write_change_log(log, str(tmp_path), "entity", "20200101")).columns
    assert files.markdown("T", spark.createDataFrame([("x", 0.5)], "a string, b double")) == "# T\n\n| a | b |\n|---|---|\n| x | 0.5 |\n"
    (tmp_path / "schema.txt").write_text("x" * 100)
    assert files.load_schema_text(spark, str(tmp_path / "schema.txt"), 10) == "x" * 10 + "\n# [TRUNCATED]"
    logger = files.log_to(str(tmp_path / "log"), "kgloom-test")
    logger.info("hello")
    assert "hello" in (tmp_path / "log").read_text()


def test_settings():
    learnt = {"predict": {"signature": {"instructions": "learnt"}}}
    config = Config(sparql_artifact=learnt)
    assert config.instruction("sparql", "default") == "learnt" and config.instruction("sparql", "default", "mine") == "mine"
    assert config.with_(use_optimized_prompts=False).instruction("sparql", "default") == "default"
    assert config.with_(sparql_instruction="own").instruction("sparql", "default") == "own"
    assert Config.preset("aggressive").absolute_prob_threshold == 2.0
    assert issubclass(SPARQLGenerationError, PipelineError) and issubclass(ConfigurationError, GraphError) and SearchMode.hybrid == "hybrid"


def test_live_or_stored(spark):
    kind = "array<map<string,struct<type:string,value:string>>>"
    rows = spark.createDataFrame([(True,), (None,)], "b boolean")
    stored = F.array(F.create_map(F.lit("s"), F.struct(F.lit("uri").alias("type"), F.lit("v").alias("value"))))
    found = [r[0] for r in rows.select(evaluate.live_or_stored(F.col("b"), F.array().cast(kind), stored)).collect()]
    assert found[0][0]["boolean"]["value"] == "true" and found[1][0]["s"]["value"] == "v"


def test_small_filters(spark):
    row = spark.createDataFrame([(["authorOf", "x"],)], "t array<string>")
    assert row.select(filters.rename_types(F.col("t"))).head()[0] == ["authoredBy", "x"]
    codes = spark.createDataFrame([("WRONG_RELATION_URI",), ("MISSING",), ("zzz",)], "c string")
    assert [r[0] for r in codes.select(evaluate.error_category(F.col("c"))).collect()] == ["Wrong Predicate", "Under-Constrained", "Other"]
