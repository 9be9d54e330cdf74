"""Question to answer (E1 to E4, E13, E14) with a pluggable language model.

A batch of questions goes through search, filters, subgraph growth and merging as one set of DataFrames keyed by
question_id; only the language model and the generated queries run question by question.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any, Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.functions.text import parse_mentions, strip_fences
from kgloom.graph import KnowledgeGraph
from kgloom.model import AnswerGenerationError, Config, SearchMode, SPARQLGenerationError
from kgloom.operators.filters import dedup_by_types, filter_relations, filter_seeds
from kgloom.operators.merge import graphs_text, labelled_triples, merged, relations_text, seeds_text, top_per_seed
from kgloom.operators.paths import subgraphs
from kgloom.operators.search import citable, seed_nodes
from kgloom.operators.vectors import search_relations, select_schema
from kgloom.plans.sparql import execute


class LanguageModel(Protocol):
    """task is entities, relations, template, sparql, answer or judge; inputs are named texts; the reply is text."""

    def __call__(self, task: str, **inputs: str) -> str: ...


class ScriptedModel:
    """Offline stand-in: replies by (task, question), else by a function, else a rule (capitalised words as mentions)."""

    def __init__(self, replies: dict[tuple[str, str], str] | None = None, rule: Callable[..., str] | None = None):
        self.replies, self.rule, self.calls = replies or {}, rule, []

    def __call__(self, task: str, **inputs: str) -> str:
        self.calls.append((task, inputs))
        question = inputs.get("question", "")
        if (task, question) in self.replies:
            return self.replies[task, question]
        if self.rule:
            return self.rule(task, **inputs)
        if task in ("entities", "relations"):
            return json.dumps([{"name": w.strip("?.,"), "types": []} for w in question.split() if w[:1].isupper()] if task == "entities" else [])
        return question if task == "template" else json.dumps({"answer": "", "citations": [], "confidence": 0.0}) if task == "answer" else ""


@dataclass
class Result:
    """What a retrieval found; failure_stage is initialization, citability, seed_finding, subgraph_extraction,
    sparql_generation or sparql_execution."""

    success: bool = False
    sparql: str | None = None
    results: list[dict] | None = None
    subgraphs: list[dict] = field(default_factory=list)
    seed_nodes: list[dict] = field(default_factory=list)
    timing: dict[str, float] = field(default_factory=dict)
    failure_stage: str | None = None
    failure_reason: str | None = None


@dataclass
class Engine:
    kg: KnowledgeGraph
    entities: DataFrame
    relations: DataFrame
    encoder: Any
    model: LanguageModel
    config: Config = field(default_factory=Config)
    schema: DataFrame | None = None  # a collection of schema terms (V9)

    @property
    def spark(self):
        return self.kg.triples.sparkSession

    def _mentions(self, questions: dict[str, str], task: str, types_key: str) -> DataFrame:
        """K8: (query_id, question_id, name, types, pos)."""
        rows = [(f"{q}/{i}", q, m["name"], m["types"], i) for q, text in questions.items() for i, m in enumerate(parse_mentions(self.model(task, question=text, instruction=self.config.instruction("extraction", "")), text, types_key))]
        return self.spark.createDataFrame(rows, "query_id string, question_id string, name string, types array<string>, pos int")

    def seeds(self, questions: dict[str, str], n: int = 3, mode: SearchMode = SearchMode.hybrid) -> DataFrame:
        """K5 for many questions."""
        mentions = self._mentions(questions, "entities", "types")
        found = seed_nodes(self.kg, mentions, self.entities, self.encoder, n, mode, self.config.type_prefix)
        return found.join(mentions.select("query_id", "question_id"), "query_id")

    def relation_nodes(self, questions: dict[str, str], n: int = 3) -> DataFrame:
        """K7's relations for many questions."""
        phrases = self._mentions(questions, "relations", "predicted_relations")
        found = search_relations(self.relations, phrases, self.encoder, n)
        return found.join(phrases.select("query_id", "question_id", F.col("name").alias("relation_from"), F.col("types").alias("relation_types"), "pos"), "query_id")

    def citable(self, question: str, n: int = 3, mode: SearchMode = SearchMode.hybrid) -> tuple[bool, dict[str, list[str]]]:
        rows = citable(self.seeds({"q": question}, n, mode), self.config.semantic_similarity_threshold, self.config.fuzzy_match_threshold).collect()
        return bool(rows), {r["entity_from"]: r["uris"] for r in rows}

    def schema_terms(self, questions: dict[str, str], n_entities: int, n_relations: int) -> dict[str, list[dict]]:
        """V9: the schema terms (uri, label, kind) nearest to each question; none without a schema."""
        found: dict[str, list[dict]] = {q: [] for q in questions}
        if self.schema is not None:
            asked = self.spark.createDataFrame(list(questions.items()), "query_id string, text string")
            for r in select_schema(self.schema, asked, self.encoder, n_entities, n_relations).orderBy("query_id", "kind", "rank").toLocalIterator():
                found[r["query_id"]].append({"uri": r["uri"], "label": r["label"], "kind": r["kind"]})
        return found

    def templates(self, questions: dict[str, str], seeds: DataFrame | None = None, relations: DataFrame | None = None) -> DataFrame:
        """One template for each question, encoded.

        With schema-aware templates the model sees the question's seeds and relations, if given, else the nearest schema
        terms; a question without either is rephrased as it is.
        """
        context: dict[str, dict[str, str]] = {q: {} for q in questions}
        if self.config.use_schema_aware_templates and seeds is not None and relations is not None:
            rows = lambda df, *columns: df.select("question_id", *columns).distinct().orderBy("question_id", *columns).toLocalIterator()  # noqa: E731  a few for each question
            held: dict[str, tuple[list, list]] = {q: ([], []) for q in questions}
            for r in rows(seeds, "entity_uri", "label", "entity_from"):
                held[r["question_id"]][0].append(r.asDict())
            for r in rows(relations, "relation_uri", "label", "relation_from"):
                held[r["question_id"]][1].append(r.asDict())
            context = {q: {"seeds": seeds_text(a), "relations": relations_text(b)} if a or b else {} for q, (a, b) in held.items()}
        elif self.config.use_schema_aware_templates and self.schema is not None:
            for q, terms in self.schema_terms(questions, self.config.schema_top_k_entities, self.config.schema_top_k_relations).items():
                shown = lambda kind, terms=terms: "\n".join(f"{t['label']} <{t['uri']}>" for t in terms if t["kind"] == kind)
                context[q] = {"entity_types": shown("entity"), "relations": shown("relation")} if terms else {}
        rows = [(q, self.model("template", question=text, **context[q]) or text) for q, text in questions.items()]
        return self.spark.createDataFrame(rows, "question_id string, text string").select("question_id", "text", self.encoder.encode(F.col("text")).alias("template"))

    def retrieve_batch(self, questions: dict[str, str], n_seeds: int = 10, n_relations: int = 3, max_hops: int = 6, max_k: int = 4, merge_k: int = 3, mode: SearchMode = SearchMode.hybrid) -> dict[str, DataFrame]:
        """Stages of all questions: seeds, filtered_seeds, relations, filtered_relations, subgraphs, merged."""
        seeds = self.seeds(questions, n_seeds, mode)
        relations = self.relation_nodes(questions, n_relations)
        kept = filter_seeds(seeds)
        kept_relations = filter_relations(dedup_by_types(relations))
        graphs = subgraphs(self.kg, kept.select("question_id", F.col("entity_uri").alias("seed_uri")), self.templates(questions, kept, kept_relations), kept_relations, self.encoder, self.config, max_hops, max_k)
        graphs = graphs.withColumn("graph_id", F.concat_ws("#", "seed_uri", F.lpad(F.col("place").cast("string"), 4, "0")))
        return {"seeds": seeds, "filtered_seeds": kept, "relations": relations, "filtered_relations": kept_relations, "subgraphs": graphs, "merged": merged(top_per_seed(graphs, merge_k))}

    def generate_sparql(self, question: str, seeds: list[dict], graphs: list[dict], relations: list[dict], retries: int = 3) -> tuple[str, list[dict]]:
        """The first query that runs (an empty result counts); errors are fed back; exhaustion raises.

        Without relations the nearest relations of the schema are shown instead.
        """
        error = ""
        if not relations:
            terms = self.schema_terms({"q": question}, 10, 20)["q"]
            relations = [{"relation_uri": t["uri"], "label": t["label"]} for t in terms if t["kind"] == "relation"]
        hints = sorted({(t["predicate"], t["predicate_uri"]) for g in graphs for t in g["triples"]} - {(x, u) for g in graphs for t in g["triples"] for x, u in [(t["predicate"], t["predicate_uri"])] if x in self.config.excluded_predicate_labels})
        for _ in range(retries):
            text = strip_fences(self.model("sparql", question=question, seeds=seeds_text(seeds), graphs=graphs_text(graphs), relations=relations_text(relations), predicates="\n".join(f"{x} <{u}>" for x, u in hints), examples="\n".join(f"{q}\n{s}" for q, s in self.config.few_shot), error=error, instruction=self.config.instruction("sparql", "")))
            ok, rows, message = execute(text, self.kg, self.config.execution_timeout)
            if ok:
                return text, rows
            error = message or "unknown error"
        raise SPARQLGenerationError(f"no query ran in {retries} rounds: {error}")

    def retrieve(self, question: str, check_citable: bool = False, n_seeds: int = 3, n_relations: int = 3, max_hops: int = 10, max_k: int = 2, retries: int = 3, mode: SearchMode = SearchMode.semantic) -> Result:
        """Seeds, subgraphs (not merged) and a query with its rows; a failure says where. No rows are a failure."""
        out, began = Result(), time.time()

        def lap(name: str) -> None:
            out.timing[name] = time.time() - began - sum(out.timing.values())

        def failed(stage: str, reason: str) -> Result:
            out.failure_stage, out.failure_reason = stage, reason
            out.timing["total"] = time.time() - began
            return out

        try:
            if check_citable and not self.citable(question, n_seeds, mode)[0]:
                return failed("citability", "no mention is in the graph")
        except Exception as e:  # noqa: BLE001
            return failed("citability", str(e))
        try:
            seeds = self.seeds({"q": question}, n_seeds, mode)
            relations = self.relation_nodes({"q": question}, n_relations)
            out.seed_nodes = [r.asDict(True) for r in seeds.collect()]
            found_relations = [r.asDict(True) for r in relations.collect()]
        except Exception as e:  # noqa: BLE001
            return failed("seed_finding", str(e))
        if not out.seed_nodes:
            return failed("seed_finding", "no seeds")
        lap("seed_finding")
        try:
            graphs = subgraphs(self.kg, seeds.select("question_id", F.col("entity_uri").alias("seed_uri")), self.templates({"q": question}, seeds, relations), relations, self.encoder, self.config, max_hops, max_k)
            out.subgraphs = [r.asDict(True) for r in graphs.withColumn("triples", labelled_triples(F.col("triplets"), F.col("path"))).collect()]
        except Exception as e:  # noqa: BLE001
            return failed("subgraph_extraction", str(e))
        if not out.subgraphs:
            return failed("subgraph_extraction", "no subgraphs")
        lap("subgraph_extraction")
        try:
            out.sparql, out.results = self.generate_sparql(question, out.seed_nodes, out.subgraphs, found_relations, retries)
        except SPARQLGenerationError as e:
            return failed("sparql_generation", str(e))
        lap("sparql_generation")
        if not out.results:
            return failed("sparql_execution", "the query has no rows")
        out.success = True
        out.timing["total"] = time.time() - began
        return out

    def answer(self, question: str, shown: int = 10, **options) -> dict:
        """An answer from the query's rows, with citations and confidence."""
        found = self.retrieve(question, **options)
        if not found.success:
            return {"success": False, "answer": None, "citations": [], "confidence": 0.0, "retrieval": found}
        more = len(found.results) - shown
        text = "\n".join(json.dumps(r, ensure_ascii=False) for r in found.results[:shown]) + (f"\n... and {more} more" if more > 0 else "")
        return {"success": True, **self._parsed("answer", question=question, sparql=found.sparql, results=text), "retrieval": found}

    def answer_from_subgraphs(self, question: str, graphs: list[dict] | None = None, **options) -> dict | None:
        """An answer without a query; None if anything fails."""
        try:
            if graphs is None:
                graphs = self.retrieve(question, **options).subgraphs
            return self._parsed("answer", question=question, sparql="", results=graphs_text(graphs)) if graphs else None
        except Exception:  # noqa: BLE001
            return None

    def _parsed(self, task: str, **inputs: str) -> dict:
        try:
            reply = json.loads(strip_fences(self.model(task, **inputs)))
            return {"answer": reply["answer"], "citations": list(reply.get("citations") or []), "confidence": float(reply.get("confidence") or 0.0)}
        except (ValueError, KeyError, TypeError) as e:
            raise AnswerGenerationError(f"the reply is no answer: {e}") from e

    def judge(self, question: str, query_type: str, golden: str, generated: str, golden_rows: list[dict], generated_rows: list[dict], shown: int = 5) -> dict:
        """The model's verdict on one pair of queries: correct, failure_code, reason; an unreadable reply is not correct."""
        try:
            reply = json.loads(strip_fences(self.model("judge", question=question, query_type=query_type, golden=golden, generated=generated, golden_rows=json.dumps(golden_rows[:shown], ensure_ascii=False), generated_rows=json.dumps(generated_rows[:shown], ensure_ascii=False))))
            return {"correct": bool(reply["correct"]), "failure_code": reply.get("failure_code"), "reason": reply.get("reason")}
        except (ValueError, KeyError, TypeError) as e:
            return {"correct": False, "failure_code": "JUDGE_ERROR", "reason": str(e)}

    def evaluate(self, questions: DataFrame, generated: str = "generated_sparql", judged: bool = True, threads: int = 4, batch: int = 64, most: int = 100_000) -> DataFrame:
        """E7 to E10 for questions (id, query_type, question, golden_sparql, generated): state, counts, F1 and verdict of each.

        Queries run in ``threads`` at once, each with the configured timeout and up to ``most`` rows; a question without a
        generated query counts as failed. Rows are written batch by batch and compared in Spark; the driver keeps of each
        question its texts and the first rows, for the judge. correct_0 is correct and wrong_0 is not; the judge decides on the others.
        """
        from concurrent.futures import ThreadPoolExecutor
        from itertools import islice

        from kgloom.functions.text import question_text
        from kgloom.operators.evaluate import compare_rows, needs_judge
        from kgloom.session import new_path

        kind, path, found, status = "golden boolean, question_id string, row string", new_path(self.spark, "answers"), {}, []
        run = lambda q: execute(q, self.kg, self.config.execution_timeout, most) if q else (False, [], "no query")
        self.spark.createDataFrame([], kind).write.parquet(path)
        asked = questions.select("id", "query_type", question_text(F.col("question")).alias("text"), "golden_sparql", F.col(generated).alias("generated")).toLocalIterator()
        with ThreadPoolExecutor(threads) as pool:
            while some := list(islice(asked, batch)):
                runs = list(pool.map(run, [q for r in some for q in (r["golden_sparql"], r["generated"])]))
                rows = []
                for i, r in enumerate(some):
                    pair = runs[2 * i : 2 * i + 2]
                    found[r["id"]] = (r, [p[1][:5] for p in pair])
                    status.append((r["id"], pair[0][0], pair[1][0]))
                    rows += [(golden, r["id"], "\x01".join(str(x[k]).strip() for k in sorted(x))) for golden, p in zip((True, False), pair, strict=True) for x in p[1]]
                self.spark.createDataFrame(rows, kind).write.mode("append").parquet(path)
        held = self.spark.read.parquet(path)
        states = compare_rows(held.where("golden"), held.where("NOT golden"), self.spark.createDataFrame(status, "question_id string, golden_ok boolean, generated_ok boolean"))
        verdicts = []
        if judged:
            for s in states.where(needs_judge(F.col("state"))).select("question_id").toLocalIterator():
                r, heads = found[s["question_id"]]
                v = self.judge(r["text"], r["query_type"], r["golden_sparql"], r["generated"], *heads)
                verdicts.append((s["question_id"], v["correct"], v["failure_code"]))
        judged_rows = self.spark.createDataFrame(verdicts, "question_id string, judged boolean, failure_code string")
        types = self.spark.createDataFrame([(q, r["query_type"]) for q, (r, _) in found.items()], "question_id string, query_type string")
        correct = F.when(F.col("state") == "correct_0", True).when(F.col("state") == "wrong_0", False).otherwise(F.col("judged"))
        return states.join(types, "question_id").join(judged_rows, "question_id", "left").withColumn("correct", correct).drop("judged")

    def baseline(self, questions: dict[str, str], level: int, schema: str = "", golden: dict[str, list[str]] | None = None) -> list[dict]:
        """Prompt-only generation: 0 with schema, 1 with nothing, 2 with schema and golden entities, 3 with retrieval."""
        out = []
        for q, text in questions.items():
            began = time.time()
            if level == 3:
                found = self.retrieve(text)
                sparql, ok, rows, error = found.sparql, found.success, found.results, found.failure_reason
            else:
                sparql = strip_fences(self.model("sparql", question=text, schema=schema if level != 1 else "", seeds="\n".join((golden or {}).get(q, [])) if level == 2 else ""))
                ok, rows, error = execute(sparql, self.kg, self.config.execution_timeout)
            out.append({"id": q, "question": text, "level": level, "sparql": sparql, "success": ok, "results": rows, "error": error, "seconds": round(time.time() - began, 3)})
        return out
