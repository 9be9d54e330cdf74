import heapq
import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgloom.functions import text as T
from kgloom.graph import KnowledgeGraph
from kgloom.model import Config, SearchMode
from kgloom.operators import evaluate, filters, merge, neighbors, paths, search, vectors
from kgloom.operators.components import connected_components
from kgloom.session import checkpoint
from tests.hand import EX, SC, hand_graph


@pytest.fixture(scope="module")
def kg(spark):
    return hand_graph(spark)


def short(x):
    return x.replace(SC, "sc:").replace(EX, "ex:").replace("http://www.w3.org/1999/02/22-rdf-syntax-ns#", "rdf:").replace("http://www.w3.org/2000/01/rdf-schema#", "rdfs:").replace("http://www.w3.org/2002/07/owl#", "owl:")


def one(spark, column, **values):
    kinds = {str: "string", int: "long", float: "double"}
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds.get(type(v), 'array<string>')}" for k, v in values.items()))
    return row.select(column).head()[0]


def test_rankings(kg):
    assert [(short(r[0]), r[1]) for r in neighbors.top_entities(kg, 9).collect()] == [("ex:p1", 6), ("ex:p2", 4), ("ex:a", 2), ("ex:b", 2), ("sc:authoredBy", 1)]
    assert {short(r[0]): r[1] for r in neighbors.relations_by_usage(kg).collect()} == {"rdf:type": 4, "sc:authoredBy": 3, "rdfs:label": 3, "sc:yearOfPublication": 2, "sc:cites": 1, "owl:inverseOf": 1, "sc:publishedIn": 1}


def test_neighbors(spark, kg):
    found = neighbors.neighbors(kg, spark.createDataFrame([(EX + "a",)], "node string"), limit=100)
    assert sorted((short(r["relation"]), short(r["neighbor"]), r["label"]) for r in found.collect()) == [("rdf:type", "sc:Person", ""), ("rdfs:label", "Ann Lee", ""), ("sc:authorOf", "ex:p1", "Graph Paths"), ("sc:authorOf", "ex:p2", "")]
    only = neighbors.neighbors(kg, spark.createDataFrame([(EX + "a",)], "node string"), allowed=[SC + "authoredBy"])
    assert only.count() == 2  # the whitelist sees the original relation


def test_candidates(spark, kg):
    start = spark.createDataFrame([([EX + "a"],), ([EX + "a", EX + "p1"],)], "nodes array<string>")
    found = {}
    for r in paths.candidates(kg, start).collect():
        found.setdefault(len(r["nodes"]), set()).add(short(r["neighbor"]))
    assert found == {1: {"sc:Person", "ex:p1", "ex:p2"}, 2: {"sc:Paper", "ex:b", "ex:p2"}}


def test_labels_and_descriptions(spark, kg):
    rows = spark.createDataFrame([(EX + "p2",), (EX + "a",), (EX + "zzTop",)], "uri string")
    assert [r["l"] for r in neighbors.with_label(kg, rows, "uri", "l").orderBy("uri").collect()] == ["Ann Lee", "p2", "zzTop"]
    assert {short(r[0]): r[1] for r in neighbors.entity_descriptions(kg, rows).collect()} == {"ex:p2": "Paper: p2", "ex:a": "Person: Ann Lee", "ex:zzTop": "zz top"}
    custom = {short(r[0]): r[1] for r in neighbors.custom_descriptions(kg, rows, lambda uri, triples: f"{len(triples)}" if triples else 1 / 0).collect()}
    assert custom == {"ex:p2": "4", "ex:a": "2", "ex:zzTop": "zz top"}


@pytest.mark.parametrize(
    "word, base",
    [("authored", "author"), ("published", "publish"), ("submitted", "submit"), ("cited", "cit"), ("created", "creat"), ("used", "use"), ("string", "str"), ("running", "run"), ("creating", "creat"), ("year", "year"), ("ed", "e")],
)
def test_verb_base(spark, word, base):
    assert one(spark, T.verb_base(F.col("w")), w=word) == base


def test_texts(spark):
    assert one(spark, T.uri_to_label(F.col("u")), u=f"<{SC}yearOfPublication>") == "year of publication"
    assert one(spark, T.relation_name(F.col("u")), u=SC + "cites") == "cites" and one(spark, T.relation_name(F.col("u")), u="plain") == "plain"
    assert one(spark, T.verb_forms(F.col("w")), w="study") == ["study", "studied", "studying"] and one(spark, T.verb_forms(F.col("w")), w="cite") == ["cite", "cited", "citing"]
    assert one(spark, T.phrase_forms(F.col("w")), w=["authored", "by"]) == ["authored by", "authored", "by", "author", "authoring", "by authored"]
    assert one(spark, T.phrase_forms(F.col("w")), w=["year", "of", "publication"]) == ["year of publication", "year", "publication"]
    assert one(spark, T.terms_of(F.col("t")), t="The year of a Publication, in year 2020") == ["year", "publication", "year"]
    assert one(spark, T.relation_description(F.lit("authoredBy"), F.lit(SC + "Publication"), F.lit(SC + "Creator"), F.array(F.lit("Written by"))), x=1) == "authoredBy authored by authored by author authoring by authored written publication creator"
    assert one(spark, T.search_variants(F.col("q")), q="  Lee,  A. ") == ["lee, a.", "lee, a", "lee a.", "lee a"]
    assert one(spark, T.search_variants(F.col("q")), q=".") == ["."]
    assert one(spark, T.enhanced_entity_query(F.lit("Ann Lee"), F.col("t")), t=["Creator", "Person"]) == "Creator Person: Ann Lee."
    assert one(spark, T.enhanced_relation_query(F.lit("in year"), F.col("t")), t=["yearOfPublication"]) == "yearOfPublication year of publication in year"
    assert one(spark, T.title_case(F.col("t")), t="o'neil 3d (abc)x") == "o'neil 3d (abc)x".title()
    assert one(spark, T.seed_label(F.col("d"), F.lit("http://x/y")), d="Person: A. Lee, B") == "A" and one(spark, T.seed_label(F.col("d"), F.lit("http://x/y")), d="none") == "y"
    assert one(spark, T.full_seed_label(F.col("d"), F.lit("http://x/y")), d="Person: A. Lee") == "A. Lee"
    assert one(spark, T.fuzzy_match(F.col("a"), F.lit(" ANN lee")), a="Ann Lee") == 1.0
    assert one(spark, T.fuzzy_label_score(F.col("a"), F.lit("Ray Bop")), a="Bob") == pytest.approx(SequenceMatcher(None, "bob", "bop").ratio())
    assert one(spark, T.fuzzy_label_score(F.col("a"), F.lit("x")), a="") == 1.0
    assert T.strip_fences("```sparql\nASK {}\n```") == "ASK {}" and T.strip_fences("ASK {}") == "ASK {}"
    assert T.parse_mentions('[{"name": " A ", "types": ["x", "", "y", "z", "w"]}, "B", {"types": []}]', "q") == [{"name": "A", "types": ["x", "y", "z"]}, {"name": "B", "types": []}]
    assert T.parse_mentions("no json", "q") == [{"name": "q", "types": []}]
    assert one(spark, T.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))), x=1) is None


def test_seed_ladder(spark):
    make = lambda *rows: spark.createDataFrame([("q", f"u{i}", label, score, "Ann Lee", ["Person"]) for i, (label, score) in enumerate(rows)], "question_id string, entity_uri string, label string, score double, entity_from string, entity_types array<string>")
    kept = lambda *rows: sorted(r["entity_uri"] for r in filters.filter_seeds(make(*rows)).collect())
    assert kept(("Ann Lee", 0.30), ("Zed", 0.10)) == ["u0", "u1"]  # a negative gap passes
    assert kept(("Ann Lee", 0.15), ("Ann Lee", 0.2099), ("Ann Lee", 0.22)) == ["u0", "u1"]
    assert kept(("Ann Lee", 0.0), ("Ann Lee", 0.05)) == ["u0"]  # a gap of the bound itself does not
    assert kept(("Ann Lee", 0.25), ("Ann Lee", 0.26), ("Ann Lee", 0.27), ("Ann Lee", 0.28)) == ["u0", "u1", "u2"]


def test_relation_ladder(spark):
    rows = spark.createDataFrame([("q", "year", f"r{i}", "l", d) for i, d in enumerate((0.35, 0.4, 0.45, 0.46))], "question_id string, relation_from string, relation_uri string, label string, distance double")
    assert sorted(r["relation_uri"] for r in filters.filter_relations(rows).collect()) == ["r0", "r1", "r2"]


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(80)] + [(1000 + i, 1001 + i) for i in range(60)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[root(a)] = root(b)
    found = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b", checkpoint).collect()}
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert set(found) == nodes
    assert all((found[x] == found[y]) == (root(x) == root(y)) for x in nodes for y in rng.sample(sorted(nodes), 20))
    assert connected_components(spark.createDataFrame([(1, 1), (None, 2)], "a long, b long"), "a", "b", checkpoint).count() == 0


def heap_search(edges, start, vectors_of, template, config, max_hops, max_k, boosted):
    """An independent priority-queue loop."""
    score = lambda text: float(np.exp(vectors_of(text) @ template / np.linalg.norm(vectors_of(text)) / np.linalg.norm(template)))
    queue, count, found = [(-0.0, 0, [start], [], 0.0)], 1, []
    while queue and len(found) < config.max_subgraphs:
        _, _, nodes, rels, before = heapq.heappop(queue)
        chosen = []
        if len(rels) < max_hops:
            options = []
            for relation, other in sorted(edges.get(nodes[-1], ())):
                if other not in nodes:
                    words = [nodes[0].rpartition("/")[2]]
                    for r, n in zip([*rels, relation], [*nodes[1:], other], strict=True):
                        words += [r.rpartition("#")[2], n.rpartition("/")[2]]
                    p = score(" ".join(words)) * (1.2 if relation in boosted else 1)
                    if p > before:
                        options.append((p, relation, other))
            seed = sorted((x for x in options if x[1] in boosted), key=lambda x: -x[0])[:5]
            rest = sorted((x for x in options if x[1] not in boosted), key=lambda x: -x[0])[:max_k]
            chosen = sorted(seed + rest, key=lambda x: -x[0])
        if chosen:
            for p, relation, other in chosen:
                heapq.heappush(queue, (-p, count, [*nodes, other], [*rels, relation], p))
                count += 1
        elif rels:
            words = [nodes[0].rpartition("/")[2]]
            for r, n in zip(rels, nodes[1:], strict=True):
                words += [r.rpartition("#")[2], n.rpartition("/")[2]]
            found.append((tuple(nodes), tuple(rels), score(" ".join(words))))
            if len(found) >= config.min_subgraphs and queue:
                head, middle = -queue[0][0], float(np.median([f[2] for f in found]))
                if head < config.absolute_prob_threshold or head < config.quality_threshold_ratio * middle:
                    break
    return {(n, r): round(p, 9) for n, r, p in found}


def test_path_search_equals_a_heap(spark):
    rng = random.Random(11)
    nodes = [f"http://g/n{i}" for i in range(14)]
    triples = sorted({(rng.choice(nodes), f"http://g/s#r{rng.randrange(4)}", rng.choice(nodes)) for _ in range(34)})
    kg = KnowledgeGraph(spark.createDataFrame([(*t, "uri", None, None) for t in triples], "s string, p string, o string, o_kind string, o_datatype string, o_lang string").coalesce(1).cache())
    edges = {}
    for s, p, o in triples:
        edges.setdefault(s, set()).add((p, o))
        edges.setdefault(o, set()).add((p, s))
    encoder = vectors.HashingEncoder(16)
    texts = spark.createDataFrame([("go r1 n3 r2",)], "t string")
    template = np.array(texts.select(encoder.encode(F.col("t"))).head()[0], float)
    cache = {}

    def vector(text):
        if text not in cache:
            cache[text] = np.array(spark.createDataFrame([(text,)], "t string").select(encoder.encode(F.col("t"))).head()[0], float)
        return cache[text]

    config = Config(min_subgraphs=2, max_subgraphs=5, absolute_prob_threshold=1.2, neighbor_limit=100)
    seeds = spark.createDataFrame([("q", n) for n in nodes[:3]], "question_id string, seed_uri string")
    templates = texts.select(F.lit("q").alias("question_id"), encoder.encode(F.col("t")).alias("template"))
    relations = spark.createDataFrame([("q", "http://g/s#r1")], "question_id string, relation_uri string")
    rows = paths.subgraphs(kg, seeds, templates, relations, encoder, config, max_hops=3, max_k=2).collect()
    for start in nodes[:3]:
        got = {((r["triplets"][0]["s"], *(t["o"] for t in r["triplets"])), tuple(t["p"] for t in r["triplets"])): round(r["probability"], 9) for r in rows if r["seed_uri"] == start}
        want = heap_search(edges, start, vector, template, config, 3, 2, {"http://g/s#r1"})
        assert set(got) == set(want)
        assert all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_replay_order(spark):
    """The next priority is the queue's head after each path."""
    row = lambda rank, probs: ("q", "s", rank, [str(i) for i in [0, *rank]], [str(i) for i in [0, *rank]], ["r"] * len(rank), "t", probs, probs[-1], len(rank))
    ended = spark.createDataFrame([row([1, 1], [1.8, 2.0]), row([1, 2], [1.8, 1.9]), row([2], [1.6])], "question_id string, seed_uri string, rank array<int>, nodes array<string>, labels array<string>, rels array<string>, text string, probs array<double>, raw double, hop int")
    found = {tuple(r["rank"]): r["next_priority"] for r in paths.replay(ended, Config.preset("disabled")).collect()}
    assert found == {(1, 1): 1.9, (1, 2): 1.6, (2,): None}


def test_merge(spark):
    step = lambda s, o: (s, "has", o)
    place = lambda s, o: [(s, s.upper(), True), ("has", "has", False), (o, o.upper(), True)]
    rows = [("q", i, [step(s, o)], place(s, o), p, 1) for i, s, o, p in (("1", "a", "b", 0.5), ("2", "b", "c", 0.9), ("3", "x", "y", 0.1), ("4", "c", "d", 0.2))]
    graphs = spark.createDataFrame(rows, "question_id string, graph_id string, triplets array<struct<s: string, p: string, o: string>>, path array<struct<uri: string, label: string, is_node: boolean>>, probability double, path_depth int")
    found = {r["cluster"]: (r["merged_from"], r["probability"], [(t["subject"], t["object_uri"]) for t in r["triples"]]) for r in merge.merged(graphs).collect()}
    assert found == {"1": (3, 0.9, [("A", "b"), ("B", "c"), ("C", "d")]), "3": (1, 0.1, [("X", "y")])}
    assert merge.merged_above(graphs).count() == 0
    assert merge.predicate_hints(merge.merged(graphs)).collect()[0]["label"] == "has"


def test_search(spark, kg):
    words = spark.createDataFrame([("1", "lee", []), ("2", "  ", []), ("3", "a", ["Person"])], "query_id string, name string, types array<string>")
    assert sorted((r["query_id"], short(r["entity_uri"])) for r in search.keyword_search(kg, words, type_prefix=SC).collect()) == [("1", "ex:a"), ("3", "ex:a"), ("3", "ex:b")]
    assert [search.shares(n) for n in (1, 2, 3, 5, 10)] == [(1, 0), (1, 1), (2, 1), (3, 2), (7, 3)]
    assert search.shares(4, SearchMode.keyword) == (0, 4)


def test_collections(spark, kg, tmp_path):
    encoder = vectors.HashingEncoder(16)
    made = vectors.compile_entities(kg, encoder, 3).cache()
    assert [(r["id"], short(r["uri"])) for r in made.orderBy("id").collect()] == [("entity_0", "ex:p1"), ("entity_1", "ex:p2"), ("entity_2", "ex:a")]
    found, built = vectors.get_or_create(spark, str(tmp_path / "c"), lambda: made)
    assert built and found.count() == 3
    assert not vectors.get_or_create(spark, str(tmp_path / "c"), lambda: made.limit(1))[1]
    asked = spark.createDataFrame([("m", "Graph Paths", ["Paper"])], "query_id string, name string, types array<string>")
    assert short(vectors.search_entities(made, asked, encoder, 1).head()["entity_uri"]) == "ex:p1"
    assert vectors.compile_relations(kg, encoder).count() == 7
    with pytest.raises(Exception):
        vectors.load(spark, str(tmp_path / "none"))


def test_nine_cases(spark):
    rows = [(g, a, p, b, min(a, b)) for g in (True, False) for p in (True, False) for a in (0, 2) for b in (0, 3)]
    found = spark.createDataFrame(rows, "g boolean, a long, p boolean, b long, c long").select("g", "a", "p", "b", evaluate.nine_cases(F.col("g"), F.col("a"), F.col("p"), F.col("b"), F.col("c")).alias("e")).collect()
    state = {(r["g"], r["a"] > 0, r["p"], r["b"] > 0): r["e"]["state"] for r in found}
    assert state[True, True, True, True] == "correct_1" and state[True, True, True, False] == "wrong_1" and state[True, False, True, True] == state[True, False, True, False] == "correct_0"
    assert {state[g, a, False, b] for g in (True, False) for a in (True, False) for b in (True, False)} == {"wrong_0"}
    assert state[False, True, True, True] == state[False, False, True, False] == "correct_1"
    both = next(r["e"] for r in found if r["g"] and r["p"] and r["a"] and r["b"])
    assert (both["precision"], both["recall"], both["f1"], both["exact_match"]) == (0.6667, 1.0, 0.8, False)


def test_numbering_spans_partitions(spark):
    rows = spark.range(1000).select(F.col("id").cast("string").alias("uri"), F.lit("x").alias("description"))
    made = vectors.compile_collection(rows, vectors.HashingEncoder(2), "e").select("id", "uri").collect()
    assert sorted(int(r["id"][2:]) for r in made) == list(range(1000))
    assert [r["uri"] for r in sorted(made, key=lambda r: int(r["id"][2:]))] == sorted(str(i) for i in range(1000))
