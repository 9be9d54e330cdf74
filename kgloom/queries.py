"""Registered queries over the star-schema test bed, with the DuckDB SQL that each must equal."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom import testbed
from kgloom.functions import text as T
from kgloom.graph import KnowledgeGraph
from kgloom.model import RDF_TYPE, RDFS_LABEL, Config
from kgloom.operators import evaluate, filters, merge, neighbors, paths, search, vectors
from kgloom.plans.sparql import compile_sparql
from kgloom.session import stored
from kgloom.testbed import CTE, KG, PREFIXES, SC

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
kg = testbed.graph


def query(sql: str | None = None, graph: bool = True):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = f"{CTE}\n{sql}" if graph else sql
        return f

    return keep


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ---------------------------------------------------------------- rankings


@query("SELECT s AS entity, count(*) AS degree FROM triples GROUP BY s ORDER BY degree DESC, s LIMIT 1000")
def top_entities_by_degree(spark, d):
    return neighbors.top_entities(kg(spark, d), 1000)


@query("SELECT e AS entity, count(*) AS degree FROM (SELECT s AS e FROM triples UNION ALL SELECT o FROM triples WHERE o_kind = 'uri') GROUP BY e ORDER BY degree DESC, e LIMIT 1000")
def top_entities_in_out_degree(spark, d):
    return neighbors.top_entities(kg(spark, d), 1000, "both")


@query("SELECT p AS relation, count(*) AS count FROM triples GROUP BY p")
def relations_by_usage(spark, d):
    return neighbors.relations_by_usage(kg(spark, d))


# ---------------------------------------------------------------- SPARQL


def sparql(name: str, text: str, sql: str, **options) -> None:
    def run(spark, d):
        return compile_sparql(text, kg(spark, d), prefixes=PREFIXES, **options)

    run.__name__ = name
    query(sql)(run)


def _t(alias: str, predicate: str) -> str:
    return f"(SELECT s, o FROM triples WHERE p = '{predicate}') {alias}"


TYPE, LABEL = RDF_TYPE, RDFS_LABEL
IN_NATION, IN_REGION, PLACED, HAS_PART, SUPPLIED, YEAR, STATUS, SEGMENT = (SC + x for x in ("inNation", "inRegion", "placedBy", "containsPart", "suppliedBy", "yearOf", "status", "segment"))

sparql("sparql_bgp_join", "SELECT ?c ?n ?r WHERE { ?c a sc:Customer ; sc:inNation ?n . ?n sc:inRegion ?r }", f"SELECT a.s AS c, b.o AS n, c.o AS r FROM {_t('a', TYPE)} JOIN {_t('b', IN_NATION)} ON a.s = b.s JOIN {_t('c', IN_REGION)} ON b.o = c.s WHERE a.o = '{SC}Customer'")
sparql("sparql_distinct", "SELECT DISTINCT ?n WHERE { ?o sc:placedBy ?c . ?c sc:inNation ?n }", f"SELECT DISTINCT b.o AS n FROM {_t('a', PLACED)} JOIN {_t('b', IN_NATION)} ON a.o = b.s")
sparql("sparql_optional_label", "SELECT ?x ?l WHERE { ?x a ?t FILTER(?t IN (sc:Order, sc:Nation)) OPTIONAL { ?x rdfs:label ?l } }", f"SELECT a.s AS x, b.o AS l FROM {_t('a', TYPE)} LEFT JOIN {_t('b', LABEL)} ON a.s = b.s WHERE a.o IN ('{SC}Order', '{SC}Nation')")
sparql("sparql_values_batch", f"SELECT ?s ?p ?o WHERE {{ VALUES ?s {{ <{KG}nation/1> <{KG}nation/7> <{KG}region/0> <{KG}none> }} ?s ?p ?o }}", f"SELECT s, p, o FROM triples WHERE s IN ('{KG}nation/1', '{KG}nation/7', '{KG}region/0')")
sparql("sparql_union", 'SELECT ?x ?w WHERE { { ?x sc:segment "BUILDING" . ?x sc:inNation ?w } UNION { ?x sc:status "P" } }', f"SELECT a.s AS x, b.o AS w FROM {_t('a', SEGMENT)} JOIN {_t('b', IN_NATION)} ON a.s = b.s WHERE a.o = 'BUILDING' UNION ALL SELECT s, NULL FROM {_t('c', STATUS)} WHERE o = 'P'")
sparql("sparql_not_exists", "SELECT ?c WHERE { ?c a sc:Customer FILTER NOT EXISTS { ?o sc:placedBy ?c } }", f"SELECT s AS c FROM {_t('a', TYPE)} WHERE o = '{SC}Customer' AND s NOT IN (SELECT o FROM {_t('b', PLACED)})")
sparql("sparql_exists", 'SELECT ?c WHERE { ?c a sc:Customer FILTER EXISTS { ?o sc:placedBy ?c ; sc:status "P" } }', f"SELECT s AS c FROM {_t('a', TYPE)} WHERE o = '{SC}Customer' AND s IN (SELECT b.o FROM {_t('b', PLACED)} JOIN {_t('e', STATUS)} ON b.s = e.s WHERE e.o = 'P')")
sparql("sparql_minus", 'SELECT ?o WHERE { ?o sc:yearOf ?y MINUS { ?o sc:status "F" } }', f"SELECT s AS o FROM {_t('a', YEAR)} WHERE s NOT IN (SELECT s FROM {_t('b', STATUS)} WHERE o = 'F')")
sparql("sparql_filter_in", f"SELECT ?c ?n WHERE {{ ?c sc:inNation ?n FILTER(?n IN (<{KG}nation/3>, <{KG}nation/4>)) }}", f"SELECT s AS c, o AS n FROM {_t('a', IN_NATION)} WHERE o IN ('{KG}nation/3', '{KG}nation/4')")
sparql("sparql_filter_text", 'SELECT ?x ?l WHERE { ?x rdfs:label ?l FILTER(CONTAINS(LCASE(?l), "an") || STRSTARTS(?l, "Supplier")) }', f"SELECT s AS x, o AS l FROM {_t('a', LABEL)} WHERE contains(lower(o), 'an') OR starts_with(o, 'Supplier')")
sparql("sparql_regex", 'SELECT ?x WHERE { ?x rdfs:label ?l FILTER REGEX(?l, "^[a-m].*1$", "i") }', f"SELECT s AS x FROM {_t('a', LABEL)} WHERE regexp_matches(o, '(?i)^[a-m].*1$')")
sparql("sparql_count", "SELECT (COUNT(?o) AS ?answer) (COUNT(DISTINCT ?c) AS ?customers) WHERE { ?o sc:placedBy ?c }", f"SELECT CAST(count(*) AS VARCHAR) AS answer, CAST(count(DISTINCT o) AS VARCHAR) AS customers FROM {_t('a', PLACED)}")
sparql("sparql_group_count_top", "SELECT ?n (COUNT(?c) AS ?k) WHERE { ?c a sc:Customer ; sc:inNation ?n } GROUP BY ?n HAVING(COUNT(?c) > 1) ORDER BY DESC(COUNT(?c)) LIMIT 10", f"SELECT b.o AS n, CAST(count(*) AS VARCHAR) AS k FROM {_t('a', TYPE)} JOIN {_t('b', IN_NATION)} ON a.s = b.s WHERE a.o = '{SC}Customer' GROUP BY b.o HAVING count(*) > 1 ORDER BY count(*) DESC, n LIMIT 10")
sparql("sparql_ask", f"ASK {{ <{KG}nation/1> sc:inRegion ?r . ?c sc:inNation <{KG}nation/1> }}", f"SELECT count(*) > 0 AS boolean FROM {_t('a', IN_REGION)} JOIN {_t('b', IN_NATION)} ON a.s = b.o WHERE a.s = '{KG}nation/1'")
sparql("sparql_superlative", "SELECT ?p (COUNT(?o) AS ?k) WHERE { ?o sc:containsPart ?p } GROUP BY ?p ORDER BY DESC(?k) LIMIT 1", f"SELECT o AS p, CAST(count(*) AS VARCHAR) AS k FROM {_t('a', HAS_PART)} GROUP BY o ORDER BY count(*) DESC, o LIMIT 1")
sparql("sparql_min_max", "SELECT ?s (MIN(?y) AS ?low) (MAX(?y) AS ?high) WHERE { ?o sc:status ?s ; sc:yearOf ?y } GROUP BY ?s", f"SELECT a.o AS s, min(b.o) AS low, max(b.o) AS high FROM {_t('a', STATUS)} JOIN {_t('b', YEAR)} ON a.s = b.s GROUP BY a.o")
sparql("sparql_year_filter", "SELECT ?o WHERE { ?o sc:yearOf ?y FILTER(?y > YEAR(NOW()) - 3) }", f"SELECT s AS o FROM {_t('a', YEAR)} WHERE CAST(o AS INT) > 1999 - 3", now=date(1999, 6, 1))
sparql("sparql_double_intent", "SELECT ?firstanswer ?secondanswer WHERE { ?firstanswer sc:inNation ?n ; a sc:Supplier . ?secondanswer sc:inRegion ?r . ?firstanswer sc:inNation ?secondanswer }", f"SELECT a.s AS firstanswer, a.o AS secondanswer FROM {_t('a', IN_NATION)} JOIN {_t('b', TYPE)} ON a.s = b.s JOIN {_t('c', IN_REGION)} ON a.o = c.s WHERE b.o = '{SC}Supplier'")
sparql("sparql_literal_match", 'SELECT ?c WHERE { ?c sc:segment "BUILDING" }', f"SELECT s AS c FROM {_t('a', SEGMENT)} WHERE o = 'BUILDING'")
sparql("sparql_bind_if", 'SELECT ?o ?age WHERE { ?o sc:yearOf ?y BIND(IF(?y >= 1996, "new", "old") AS ?age) }', f"SELECT s AS o, CASE WHEN CAST(o AS INT) >= 1996 THEN 'new' ELSE 'old' END AS age FROM {_t('a', YEAR)}")
sparql("sparql_subselect", "SELECT ?c ?k ?n WHERE { { SELECT ?c (COUNT(?o) AS ?k) WHERE { ?o sc:placedBy ?c } GROUP BY ?c } ?c sc:inNation ?n FILTER(?k > 12) }", f"SELECT a.c, CAST(a.k AS VARCHAR) AS k, b.o AS n FROM (SELECT o AS c, count(*) AS k FROM {_t('x', PLACED)} GROUP BY o) a JOIN {_t('b', IN_NATION)} ON a.c = b.s WHERE a.k > 12")
sparql("sparql_order_offset", "SELECT ?l WHERE { ?x a sc:Nation ; rdfs:label ?l } ORDER BY DESC(?l) LIMIT 5 OFFSET 3", f"SELECT b.o AS l FROM {_t('a', TYPE)} JOIN {_t('b', LABEL)} ON a.s = b.s WHERE a.o = '{SC}Nation' ORDER BY l DESC LIMIT 5 OFFSET 3")


# ---------------------------------------------------------------- texts and URIs


@query(f"""SELECT DISTINCT u AS uri, lower(trim(translate(regexp_replace(split_part(u, CASE WHEN contains(u, '#') THEN '#' ELSE '/' END, -1), '([a-z])([A-Z])', '\\1 \\2', 'g'), '_-', '  '))) AS label,
  split_part(u, CASE WHEN contains(u, '#') THEN '#' ELSE '/' END, -1) AS relation, split_part(split_part(u, '#', -1), '/', -1) AS tail, split_part(split_part(u, '/', -1), '#', -1) AS node
FROM (SELECT s AS u FROM triples UNION ALL SELECT p FROM triples UNION ALL SELECT o FROM triples WHERE o_kind = 'uri')""")
def uri_labels(spark, d):
    g = kg(spark, d).triples
    u = g.select(F.col("s").alias("uri")).union(g.select("p")).union(g.where("o_kind = 'uri'").select("o")).distinct()
    c = F.col("uri")
    return u.select("uri", T.uri_to_label(c).alias("label"), T.relation_name(c).alias("relation"), T.tail_label(c).alias("tail"), T.node_tail(c).alias("node"))


@query("SELECT p, lower(array_to_string(string_split(regexp_replace(n, '([a-z])([A-Z])', '\\1 \\2', 'g'), ' '), '|')) AS words FROM (SELECT DISTINCT p, split_part(p, CASE WHEN contains(p, '#') THEN '#' ELSE '/' END, -1) AS n FROM triples)")
def camel_words(spark, d):
    return kg(spark, d).triples.select("p").distinct().select("p", F.array_join(T.camel_words(T.relation_name(F.col("p"))), "|").alias("words"))


@query(
    """WITH b AS (SELECT p_partkey, trim(regexp_replace(lower(p_name || '. ' || p_type || ', Co.'), '\\s+', ' ', 'g')) AS q FROM part),
v AS (SELECT p_partkey, q, trim(replace(q, '.', '')) AS x, trim(replace(q, ',', '')) AS y, trim(replace(replace(q, '.', ''), ',', '')) AS z FROM b)
SELECT p_partkey, q || '|' || x || '|' || y || '|' || z AS variants FROM v""",
    graph=False,
)
def search_variants(spark, d):
    text = F.concat("p_name", F.lit(". "), "p_type", F.lit(", Co."))
    return table(spark, d, "part").select("p_partkey", F.array_join(T.search_variants(text), "|").alias("variants"))


@query("SELECT s AS uri, CASE p WHEN 'x' THEN '' ELSE CASE WHEN k = 'Order' THEN 'Order: ' || split_part(s, '/', -1) ELSE k || ': ' || l END END AS description FROM (SELECT t.s, t.p, split_part(t.o, '#', 2) AS k, coalesce(lab.label, '') AS l FROM triples t LEFT JOIN lab ON lab.uri = t.s WHERE t.p = '" + TYPE + "')")
def entity_description(spark, d):
    g = kg(spark, d)
    return neighbors.entity_descriptions(g, g.triples.where(F.col("p") == TYPE).select(F.col("s").alias("uri")))


@query(f"SELECT s AS relation, max(CASE WHEN p = '{TYPE}' THEN o END) AS type, coalesce(string_agg(DISTINCT CASE WHEN p = '{LABEL}' THEN o END, '|'), '') AS labels FROM triples GROUP BY s")
def relation_metadata(spark, d):
    g = kg(spark, d)
    rows = neighbors.relation_metadata(g, g.triples.select(F.col("s").alias("uri")))
    return rows.select("relation", "type", F.array_join("labels", "|").alias("labels"))


@query()
def relation_description(spark, d):
    g = kg(spark, d)
    return vectors.relation_texts(g, g.triples.select(F.col("p").alias("uri")).distinct())


@query(
    """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_name ELSE p_brand || ' ' || p_type || ': ' || p_name || '.' END AS entity_text,
  CASE WHEN contains(d, ':') THEN trim(split_part(split_part(d, ':', 2), '.', 1)) ELSE split_part(d, '/', -1) END AS seed_label
FROM (SELECT *, CASE WHEN p_size % 2 = 0 THEN 'Part: ' || p_name || '. ' || p_brand ELSE p_type END AS d FROM part)""",
    graph=False,
)
def query_texts(spark, d):
    p = table(spark, d, "part")
    types = F.when(F.col("p_size") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array("p_brand", "p_type"))
    text = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("Part: "), "p_name", F.lit(". "), "p_brand")).otherwise(F.col("p_type"))
    return p.select("p_partkey", T.enhanced_entity_query(F.col("p_name"), types).alias("entity_text"), T.seed_label(text, F.col("p_type")).alias("seed_label"))


@query()
def fuzzy_scores(spark, d):
    n = table(spark, d, "nation").select("n_name", "n_regionkey")
    r = table(spark, d, "region")
    return n.join(r, n["n_regionkey"] == r["r_regionkey"]).select("n_name", "r_name", T.fuzzy_match(F.col("n_name"), F.col("r_name")).alias("ratio"), T.fuzzy_label_score(F.col("n_name"), F.col("r_name")).alias("score"))


# ---------------------------------------------------------------- neighbours and keyword search

NEIGHBORS = """, f AS (SELECT uri AS node FROM (SELECT DISTINCT s AS uri FROM triples WHERE p = '{t}' AND o = '{sc}{kind}')),
e AS (SELECT f.node, t.p AS relation, t.o AS neighbor, 1 AS outgoing, t.p AS k FROM f JOIN triples t ON t.s = f.node
  UNION SELECT f.node, coalesce(inv.inv, t.p), t.s, 0, t.p FROM f JOIN triples t ON t.o = f.node LEFT JOIN inv ON inv.p = t.p),
r AS (SELECT *, row_number() OVER (PARTITION BY node, outgoing ORDER BY k, relation, neighbor) AS n FROM e)
SELECT r.node, r.relation, r.neighbor, coalesce(lab.label, '') AS label, max(r.outgoing) = 1 AS outgoing FROM r LEFT JOIN lab ON lab.uri = r.neighbor WHERE n <= {limit} GROUP BY ALL"""


@query(NEIGHBORS.format(t=TYPE, sc=SC, kind="Customer", limit=100).replace("max(r.outgoing) = 1 AS outgoing", "max(r.outgoing) = 1 AS outgoing").replace("GROUP BY ALL", "GROUP BY r.node, r.relation, r.neighbor, lab.label"))
def neighbors_bidirectional(spark, d):
    g = kg(spark, d)
    nodes = g.triples.where((F.col("p") == TYPE) & (F.col("o") == SC + "Customer")).select(F.col("s").alias("node"))
    return neighbors.neighbors(g, nodes, limit=100)


@query(f", k(query_id, w) AS (VALUES ('a', 'an'), ('b', 'supplier'), ('c', '#00000001'), ('d', 'no such thing')), h AS (SELECT k.query_id, lab.uri, lab.label, row_number() OVER (PARTITION BY k.query_id ORDER BY lab.label, lab.uri) AS rank FROM lab JOIN k ON contains(lower(lab.label), k.w)) SELECT query_id, uri AS entity_uri, label, CAST(rank AS INT) AS rank FROM h WHERE rank <= 10")
def keyword_search(spark, d):
    words = spark.createDataFrame([("a", "AN"), ("b", "Supplier"), ("c", "#00000001"), ("d", "no such thing"), ("e", "  ")], "query_id string, name string")
    return search.keyword_search(kg(spark, d), words, 10)


@query(f", k(query_id, w, t) AS (VALUES ('a', 'an', '{SC}Nation'), ('b', '0001', '{SC}Customer')), h AS (SELECT k.query_id, lab.uri, lab.label, row_number() OVER (PARTITION BY k.query_id ORDER BY lab.label, lab.uri) AS rank FROM lab JOIN k ON contains(lower(lab.label), k.w) JOIN triples t ON t.s = lab.uri AND t.p = '{TYPE}' AND t.o = k.t) SELECT query_id, uri AS entity_uri, label, CAST(rank AS INT) AS rank FROM h WHERE rank <= 10")
def keyword_search_typed(spark, d):
    words = spark.createDataFrame([("a", "an", ["Nation", "Place"]), ("b", "0001", ["Customer"])], "query_id string, name string, types array<string>")
    return search.keyword_search(kg(spark, d), words, 10, type_prefix=SC)


# ---------------------------------------------------------------- vectors

_COS = "list_cosine_similarity(CAST(b.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))"


@query(f"WITH r AS (SELECT a.vec_id AS query_id, b.vec_id, round(1 - {_COS}, 6) AS distance, row_number() OVER (PARTITION BY a.vec_id ORDER BY 1 - {_COS}, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON true WHERE a.vec_id % 20 = 0) SELECT query_id, vec_id, distance, CAST(rank AS INT) AS rank FROM r WHERE rank <= 5", graph=False)
def knn_cosine(spark, d):
    e = table(spark, d, "embeddings")
    asked = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return vectors.nearest(e, asked, 5, id_col="vec_id", columns=["vec_id"]).select("query_id", "vec_id", F.round("distance", 6).alias("distance"), "rank")


@query(f"SELECT b.vec_id, round(exp({_COS}), 6) AS score FROM embeddings b JOIN (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) a ON true", graph=False)
def exp_cosine_scores(spark, d):
    e = table(spark, d, "embeddings")
    first = e.orderBy("vec_id").limit(1).select(F.col("embedding").alias("t"))
    return e.join(F.broadcast(first), F.lit(True)).select("vec_id", F.round(T.exp_cosine(F.col("embedding"), F.col("t")), 6).alias("score"))


def _parts(spark, d):
    return table(spark, d, "part").select(F.concat(F.lit("part_"), F.col("p_partkey").cast("string")).alias("id"), F.concat(F.lit("u"), (F.col("p_partkey") % 997).cast("string")).alias("uri"), F.col("p_brand").alias("label"), F.col("p_name").alias("description"), F.array(F.lit(1.0).cast("float")).alias("embedding"))


def _changes(spark, d):
    s = table(spark, d, "supplier")
    return s.select(F.concat(F.lit("u"), (900 + F.col("s_suppkey") * 7).cast("string")).alias("uri"), F.col("s_name").alias("label"), F.when(F.col("s_suppkey") % 5 == 0, "  ").otherwise(F.concat(F.lit("about "), "s_name")).alias("description"), F.array(F.lit(0.5).cast("float")).alias("embedding"))


_UPSERT = """WITH c AS (SELECT 'part_' || p_partkey AS id, p_partkey AS n, 'u' || (p_partkey % 997) AS uri, p_brand AS label, p_name AS description FROM part),
x AS (SELECT 'u' || (900 + s_suppkey * 7) AS uri, s_name AS label, 'about ' || s_name AS description FROM supplier WHERE s_suppkey % 5 <> 0),
f AS (SELECT uri, min(n) AS n FROM c GROUP BY uri),
k AS (SELECT x.*, f.n, CASE WHEN f.n IS NULL THEN row_number() OVER (PARTITION BY f.n IS NULL ORDER BY x.uri) END AS i FROM x LEFT JOIN f USING (uri))
"""


@query(_UPSERT + "SELECT id, uri, label, description FROM c WHERE n NOT IN (SELECT n FROM k WHERE n IS NOT NULL) UNION ALL SELECT 'part_' || n, uri, label, description FROM k WHERE n IS NOT NULL UNION ALL SELECT 'part_' || ((SELECT max(n) FROM c) + i), uri, label, description FROM k WHERE n IS NULL", graph=False)
def collection_upsert(spark, d):
    return vectors.upsert(_parts(spark, d), _changes(spark, d), "part")[0].drop("embedding")


@query(_UPSERT + "SELECT uri, description, CASE WHEN n IS NULL THEN 'added' ELSE 'updated' END AS status FROM k", graph=False)
def collection_change_log(spark, d):
    return vectors.upsert(_parts(spark, d), _changes(spark, d), "part")[1]


@query("SELECT 'part_' || p_partkey AS id, 'u' || (p_partkey % 997) AS uri FROM part WHERE 'u' || (p_partkey % 997) NOT IN (SELECT 'u' || (900 + s_suppkey * 7) FROM supplier)", graph=False)
def collection_delete(spark, d):
    return vectors.delete(_parts(spark, d), _changes(spark, d))[0].select("id", "uri")


@query("WITH u AS (SELECT s AS uri, count(*) AS degree FROM triples GROUP BY s) SELECT 1 AS one".replace("SELECT 1 AS one", "SELECT 'entity_' || (row_number() OVER (ORDER BY degree DESC, uri) - 1) AS id, uri FROM u").replace("WITH u", ", u", 1))
def compile_entities(spark, d):
    return vectors.compile_entities(kg(spark, d), vectors.HashingEncoder(8), None).select("id", "uri")


# ---------------------------------------------------------------- hybrid search and filters

_SEEDS = """s AS (SELECT n_regionkey AS question_id, n_name AS entity_from, 'c' || c_custkey AS entity_uri, CASE WHEN c_custkey % 7 = 0 THEN n_name || ' ' || c_name ELSE c_name END AS label,
  round(abs(c_acctbal) / 20000, 4) AS score, CASE WHEN c_custkey % 11 = 0 THEN 'Literal' ELSE 'Thing' END AS kind FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def _seeds(spark, d):
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    key = F.col("c_custkey")
    return c.join(n, c["c_nationkey"] == n["n_nationkey"]).select(
        F.col("n_regionkey").alias("question_id"), F.col("n_name").alias("entity_from"), F.concat(F.lit("c"), key.cast("string")).alias("entity_uri"),
        F.when(key % 7 == 0, F.concat("n_name", F.lit(" "), "c_name")).otherwise(F.col("c_name")).alias("label"), F.round(F.abs("c_acctbal") / 20000, 4).alias("score"),
        F.array(F.when(key % 11 == 0, "Literal").otherwise("Thing")).alias("entity_types"),
    )


_LADDER = "CASE WHEN best < 0.15 THEN {} WHEN best < 0.25 THEN {} WHEN best < 0.35 THEN {} ELSE {} END"


@query(f"""WITH {_SEEDS}, f AS (SELECT *, CASE WHEN contains(lower(trim(label)), lower(trim(entity_from))) OR contains(lower(trim(entity_from)), lower(trim(label))) THEN 1.0 ELSE 0.0 END AS fuzzy FROM s WHERE kind <> 'Literal'),
b AS (SELECT *, first_value(score) OVER w AS best, row_number() OVER w AS place FROM f WINDOW w AS (PARTITION BY question_id, entity_from ORDER BY fuzzy DESC, score, entity_uri)),
k AS (SELECT *, row_number() OVER (PARTITION BY question_id, entity_from ORDER BY place) AS n FROM b WHERE score - best < {_LADDER.format(0.05, 0.06, 0.05, 0.04)})
SELECT question_id, entity_from, entity_uri FROM k WHERE n <= {_LADDER.format(2, 2, 3, 2)}""", graph=False)
def filter_seeds_adaptive(spark, d):
    return filters.filter_seeds(_seeds(spark, d), exact=False).select("question_id", "entity_from", "entity_uri")


@query(f"""WITH {_SEEDS}, b AS (SELECT *, min(score) OVER (PARTITION BY question_id, entity_from) AS best FROM s),
k AS (SELECT *, row_number() OVER (PARTITION BY question_id, entity_from ORDER BY score, entity_uri) AS n FROM b WHERE score - best < {_LADDER.format(0.10, 0.15, 0.15, 0.15)})
SELECT question_id, entity_from AS relation_from, entity_uri AS relation_uri FROM k WHERE n <= {_LADDER.format(1, 2, 2, 3)}""", graph=False)
def filter_relations_adaptive(spark, d):
    rows = _seeds(spark, d).select("question_id", F.col("entity_from").alias("relation_from"), F.col("entity_uri").alias("relation_uri"), "label", F.col("score").alias("distance"))
    return filters.filter_relations(rows).select("question_id", "relation_from", "relation_uri")


@query("""WITH r AS (SELECT p_size % 5 AS question_id, p_brand AS relation_from, 'p' || p_partkey AS relation_uri, p_partkey AS pos, split_part(p_type, ' ', 1) AS t FROM part),
f AS (SELECT question_id, t, min_by(relation_from, pos) AS first FROM r GROUP BY question_id, t) SELECT r.question_id, r.relation_from, r.relation_uri FROM r JOIN f ON r.question_id = f.question_id AND r.t = f.t AND r.relation_from = f.first""", graph=False)
def dedup_relation_types(spark, d):
    rows = table(spark, d, "part").select((F.col("p_size") % 5).alias("question_id"), F.col("p_brand").alias("relation_from"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("relation_uri"), F.col("p_partkey").alias("pos"), F.array(F.split_part("p_type", F.lit(" "), F.lit(1))).alias("relation_types"))
    return filters.dedup_by_types(rows).select("question_id", "relation_from", "relation_uri")


@query("""WITH a AS (SELECT CAST(n_nationkey AS VARCHAR) AS query_id, 's' || s_suppkey AS entity_uri, s_acctbal AS score, row_number() OVER (PARTITION BY n_nationkey ORDER BY s_acctbal, s_suppkey) AS rank FROM supplier JOIN nation ON s_nationkey = n_nationkey),
b AS (SELECT CAST(n_nationkey AS VARCHAR) AS query_id, 's' || s_suppkey AS entity_uri, row_number() OVER (PARTITION BY n_nationkey ORDER BY s_name, s_suppkey) AS rank FROM supplier JOIN nation ON s_nationkey = n_nationkey),
u AS (SELECT query_id, entity_uri, 0 AS w, rank, score FROM a WHERE rank <= 3 UNION ALL SELECT query_id, entity_uri, 1, rank, 0.0 FROM b WHERE rank <= 2),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id, entity_uri ORDER BY w, rank) AS n FROM u),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY w, rank, entity_uri) AS place FROM o WHERE n = 1)
SELECT query_id, entity_uri, CASE w WHEN 0 THEN 'semantic' ELSE 'keyword' END AS source, score, CAST(place AS INT) AS place FROM p WHERE place <= 5""", graph=False)
def hybrid_search(spark, d):
    from pyspark.sql import Window as W

    s = table(spark, d, "supplier").select(F.col("s_nationkey").cast("string").alias("query_id"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("entity_uri"), F.col("s_name").alias("label"), F.col("s_acctbal").alias("distance"), "s_suppkey")
    near = s.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("distance", "s_suppkey"))).withColumn("description", F.col("label"))
    words = s.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("label", "s_suppkey")))
    return search.hybrid(near, words, 5).select("query_id", "entity_uri", "source", "score", "place")


@query("""WITH g AS (SELECT c_nationkey AS id, list(c_custkey ORDER BY c_custkey) AS golden, list(c_custkey ORDER BY c_custkey) FILTER (c_custkey % 3 <> 0) AS b, list(c_custkey ORDER BY c_custkey) FILTER (c_custkey % 6 = 1) AS a FROM customer GROUP BY c_nationkey)
SELECT id, CAST(len(golden) AS INT) AS n_golden, CAST(len(coalesce(b, [])) AS INT) AS covered_before, CAST(len(coalesce(a, [])) AS INT) AS covered_after, CASE WHEN len(coalesce(b, [])) = len(coalesce(a, [])) THEN 'PASS' ELSE 'FAIL' END AS verdict FROM g""", graph=False)
def coverage_stats(spark, d):
    key = F.col("c_custkey").cast("string")
    rows = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("id")).agg(F.collect_list(F.concat(F.lit("<"), key, F.lit(">"))).alias("golden"), F.collect_list(F.when(F.col("c_custkey") % 3 != 0, key)).alias("b"), F.collect_list(F.when(F.col("c_custkey") % 6 == 1, key)).alias("a"))
    return filters.coverage_stats(rows, "golden", "b", "a").select("id", "n_golden", "covered_before", "covered_after", "verdict")


# ---------------------------------------------------------------- paths and merging


@query(f""", s AS (SELECT s AS seed FROM triples WHERE p = '{TYPE}' AND o = '{SC}Region'),
e AS MATERIALIZED (SELECT s AS a, p AS r, o AS b FROM triples WHERE starts_with(o, 'http') UNION SELECT t.o, coalesce(inv.inv, t.p), t.s FROM triples t LEFT JOIN inv ON inv.p = t.p WHERE starts_with(t.o, 'http')),
one AS MATERIALIZED (SELECT s.seed, e.r AS r1, e.b AS n1 FROM s JOIN e ON e.a = s.seed WHERE e.b <> s.seed)
SELECT one.seed AS seed_uri, one.r1 || '|' || e.r AS rels, one.n1 || '|' || e.b AS steps FROM one JOIN e ON e.a = one.n1 WHERE e.b <> one.seed AND e.b <> one.n1""")
def path_expand_2hop(spark, d):
    g = kg(spark, d)
    start = g.triples.where((F.col("p") == TYPE) & (F.col("o") == SC + "Region")).select(F.col("s").alias("seed_uri"), F.array("s").alias("nodes"))
    one = paths.candidates(g, start).select("seed_uri", F.col("relation").alias("r1"), F.concat("nodes", F.array("neighbor")).alias("nodes"))
    two = paths.candidates(g, one)
    return two.select("seed_uri", F.concat_ws("|", "r1", "relation").alias("rels"), F.concat_ws("|", F.element_at("nodes", -1), "neighbor").alias("steps"))


@query()
def subgraph_search(spark, d):
    g, encoder = kg(spark, d), vectors.HashingEncoder()
    seeds = g.triples.where((F.col("p") == TYPE) & (F.col("o") == SC + "Nation")).select(F.col("s").alias("seed_uri"))
    seeds = seeds.withColumn("question_id", F.element_at(F.split("seed_uri", "/"), -1))
    templates = seeds.select("question_id", encoder.encode(F.concat(F.lit("nation customer placed order "), "question_id")).alias("template"))
    relations = seeds.select("question_id", F.lit(SC + "placed").alias("relation_uri"))
    found = paths.subgraphs(g, seeds, templates, relations, encoder, Config(neighbor_limit=20), max_hops=3, max_k=3)
    return found.select("question_id", "seed_uri", merge.labelled_triples(F.col("triplets"), F.col("path")).alias("triples"), F.round("probability", 6).alias("probability"), "path_depth", "place")


_GRAPHS = """g AS (SELECT c_nationkey AS question_id, lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS graph_id, 'c' || o_custkey AS seed_uri, o_totalprice AS probability, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place FROM orders JOIN customer ON o_custkey = c_custkey)"""


def _graphs(spark, d):
    from pyspark.sql import Window as W

    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    rows = o.join(c, o["o_custkey"] == c["c_custkey"])
    return rows.select(F.col("c_nationkey").alias("question_id"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("graph_id"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("seed_uri"), F.col("o_totalprice").alias("probability"), F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")).alias("place"), "o_orderkey")


@query(f"WITH {_GRAPHS}, r AS (SELECT *, row_number() OVER (PARTITION BY question_id, seed_uri ORDER BY probability DESC, place) AS n FROM g) SELECT question_id, seed_uri, graph_id FROM r WHERE n <= 3", graph=False)
def topk_per_seed(spark, d):
    return merge.top_per_seed(_graphs(spark, d)).select("question_id", "seed_uri", "graph_id")


_MERGE = """WITH RECURSIVE t AS (SELECT DISTINCT c_nationkey AS q, lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS g, 'order' || o_orderkey AS s, 'part' || l_partkey AS o, o_totalprice AS pr
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P'),
n AS (SELECT DISTINCT q, g, s AS node FROM t UNION SELECT DISTINCT q, g, o FROM t),
e AS (SELECT DISTINCT a.q, a.g AS x, b.g AS y FROM n a JOIN n b ON a.q = b.q AND a.node = b.node),
w(q, x, y) AS (SELECT q, x, y FROM e UNION SELECT w.q, w.x, e.y FROM w JOIN e ON w.q = e.q AND w.y = e.x),
k AS (SELECT q, x AS g, min(y) AS cluster FROM w GROUP BY q, x)
SELECT k.q AS question_id, k.cluster, string_agg(DISTINCT t.s || '>' || t.o, '|' ORDER BY t.s || '>' || t.o) AS triples, max(t.pr) AS probability, count(DISTINCT t.g) AS merged_from FROM k JOIN t ON k.q = t.q AND k.g = t.g GROUP BY k.q, k.cluster"""


def _order_merge(o, c, line):
    """Orders as subgraphs of their customers' nations, merged where they share parts."""
    rows = o.join(c, o["o_custkey"] == c["c_custkey"]).join(line, o["o_orderkey"] == line["l_orderkey"])
    s, p = F.concat(F.lit("order"), F.col("o_orderkey").cast("string")), F.concat(F.lit("part"), F.col("l_partkey").cast("string"))
    step = F.struct(s.alias("s"), F.lit("has").alias("p"), p.alias("o"))
    graphs = rows.groupBy(F.col("c_nationkey").alias("question_id"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("graph_id")).agg(F.array_sort(F.collect_set(step)).alias("triplets"), F.max("o_totalprice").alias("probability"))
    graphs = stored(graphs, "graphs")  # merging reads them several times
    spot = lambda u, flag: F.struct(u.alias("uri"), u.alias("label"), F.lit(flag).alias("is_node"))
    graphs = graphs.withColumn("path", F.flatten(F.transform("triplets", lambda t: F.array(spot(t["s"], True), spot(t["p"], False), spot(t["o"], True))))).withColumn("path_depth", F.lit(1))
    found = merge.merged(graphs)
    joined = F.array_join(F.array_sort(F.transform("triples", lambda t: F.concat(t["subject_uri"], F.lit(">"), t["object_uri"]))), "|")
    return found.select("question_id", "cluster", joined.alias("triples"), "probability", "merged_from")


@query(_MERGE, graph=False)
def connected_merge(spark, d):
    return _order_merge(table(spark, d, "orders").where("o_orderstatus = 'P'"), table(spark, d, "customer"), table(spark, d, "lineitem"))


@query()
def connected_merge_all(spark, d):
    return _order_merge(table(spark, d, "orders"), table(spark, d, "customer"), table(spark, d, "lineitem"))


# ---------------------------------------------------------------- validation and evaluation

_SETS = """o AS (SELECT o_orderkey AS question_id, o_orderkey % 13 <> 0 AS golden_ok, o_orderkey % 11 <> 0 AS generated_ok, o_orderpriority AS query_type FROM orders),
a AS (SELECT DISTINCT l_orderkey AS question_id, trim(CAST(l_partkey AS VARCHAR)) AS row FROM lineitem WHERE l_orderkey % 7 <> 0),
b AS (SELECT DISTINCT l_orderkey AS question_id, trim(CAST(l_partkey AS VARCHAR)) AS row FROM lineitem WHERE l_orderkey % 5 <> 0 AND l_linenumber % 4 <> 3),
z AS (SELECT coalesce(a.question_id, b.question_id) AS question_id, count(a.row) AS x, count(b.row) AS y, count(CASE WHEN a.row IS NOT NULL AND b.row IS NOT NULL THEN 1 END) AS c FROM a FULL JOIN b ON a.question_id = b.question_id AND a.row = b.row GROUP BY 1),
m AS (SELECT o.*, coalesce(x, 0) AS x, coalesce(y, 0) AS y, coalesce(c, 0) AS c FROM o LEFT JOIN z ON o.question_id = z.question_id),
e AS (SELECT question_id, query_type, CASE WHEN NOT generated_ok THEN 'wrong_0' WHEN NOT golden_ok THEN 'correct_1' WHEN x = 0 THEN 'correct_0' WHEN y = 0 THEN 'wrong_1' ELSE 'correct_1' END AS state,
  CASE WHEN golden_ok THEN x ELSE 0 END AS golden_count, CASE WHEN generated_ok THEN y ELSE 0 END AS generated_count,
  CASE WHEN NOT generated_ok THEN 0.0 WHEN NOT golden_ok THEN NULL WHEN x = 0 THEN 1.0 WHEN y = 0 THEN 0.0 ELSE round_even(CAST(c AS DOUBLE) / y, 4) END AS precision,
  CASE WHEN NOT generated_ok THEN 0.0 WHEN NOT golden_ok THEN NULL WHEN x = 0 THEN 1.0 WHEN y = 0 THEN 0.0 ELSE round_even(CAST(c AS DOUBLE) / x, 4) END AS recall FROM m)"""


def _compared(spark, d):
    o, line = table(spark, d, "orders"), table(spark, d, "lineitem")
    row = line.select(F.col("l_orderkey").alias("question_id"), F.col("l_partkey").cast("string").alias("row"), "l_linenumber")
    status = o.select(F.col("o_orderkey").alias("question_id"), (F.col("o_orderkey") % 13 != 0).alias("golden_ok"), (F.col("o_orderkey") % 11 != 0).alias("generated_ok"))
    return evaluate.compare_rows(row.where("question_id % 7 <> 0"), row.where("question_id % 5 <> 0 AND l_linenumber % 4 <> 3"), status)


@query(f"WITH {_SETS} SELECT question_id, state, golden_count, generated_count, precision, recall FROM e", graph=False)
def nine_case_eval(spark, d):
    return _compared(spark, d).select("question_id", "state", "golden_count", "generated_count", "precision", "recall")


@query(f"WITH {_SETS} SELECT coalesce(query_type, 'ALL') AS query_type, count(*) AS total, count(CASE WHEN state = 'correct_0' THEN 1 END) AS correct_0, count(CASE WHEN state = 'correct_1' THEN 1 END) AS correct_1, count(CASE WHEN state = 'wrong_0' THEN 1 END) AS wrong_0, count(CASE WHEN state = 'wrong_1' THEN 1 END) AS wrong_1 FROM e GROUP BY ROLLUP (query_type)", graph=False)
def f1_by_query_type(spark, d):
    types = table(spark, d, "orders").select(F.col("o_orderkey").alias("question_id"), F.col("o_orderpriority").alias("query_type"))
    return evaluate.stats_by_type(_compared(spark, d).join(types, "question_id")).drop("mean_f1")


@query("""WITH k AS (SELECT count(DISTINCT o_orderpriority) AS k FROM orders), t AS (SELECT o_orderpriority AS query_type, row_number() OVER (ORDER BY o_orderpriority) - 1 AS i FROM (SELECT DISTINCT o_orderpriority FROM orders)),
r AS (SELECT o_orderkey AS id, o_orderpriority AS query_type, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS n FROM orders)
SELECT r.id, r.query_type FROM r JOIN t ON r.query_type = t.query_type JOIN k ON true WHERE r.n <= 123 // k.k + CASE WHEN t.i < 123 % k.k THEN 1 ELSE 0 END""", graph=False)
def balanced_sample(spark, d):
    return evaluate.balanced_sample(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("query_type")), 123)


_TYPES = "CASE o_orderkey % 7 WHEN 0 THEN 'SINGLE_FACT' WHEN 1 THEN 'COUNT' WHEN 2 THEN 'BOOLEAN' WHEN 3 THEN 'SUPERLATIVE+COMPARATIVE' WHEN 4 THEN 'DOUBLE_INTENT' WHEN 5 THEN 'OTHER' ELSE 'MULTI_FACT' END"


@query(f"""WITH p AS (SELECT l_orderkey, list(DISTINCT 'http://e/part/' || l_partkey) AS nodes, 'http://e/part/' || min(l_suppkey) AS answer, 'http://e/part/' || max(l_partkey) AS entity FROM lineitem GROUP BY l_orderkey),
x AS (SELECT o_orderkey AS question_id, {_TYPES} AS query_type, o_orderkey % 3 = 0 AS literal, list_contains(nodes, answer) AS by_uri, o_orderkey % 2 = 0 AS by_predicate, o_orderkey % 4 = 0 AND list_contains(nodes, entity) AS by_entity FROM orders JOIN p ON o_orderkey = l_orderkey)
SELECT question_id, query_type, CASE WHEN query_type IN ('SINGLE_FACT', 'MULTI_FACT', 'DOUBLE_INTENT') THEN CASE WHEN literal THEN by_predicate ELSE by_uri END WHEN query_type IN ('BOOLEAN', 'COUNT') THEN by_entity WHEN query_type = 'SUPERLATIVE+COMPARATIVE' THEN by_uri OR by_entity ELSE by_uri END AS valid FROM x""", graph=False)
def validate_by_type(spark, d):
    o, line = table(spark, d, "orders"), table(spark, d, "lineitem")
    uri = lambda c: F.concat(F.lit("http://e/part/"), c.cast("string"))
    p = line.groupBy("l_orderkey").agg(F.collect_set(uri(F.col("l_partkey"))).alias("nodes"), uri(F.min("l_suppkey")).alias("answer"), uri(F.max("l_partkey")).alias("entity"))
    k = F.col("o_orderkey")
    kind = F.expr(_TYPES)
    path = F.transform("nodes", lambda n: F.struct(n.alias("uri"), n.alias("label"), F.lit(True).alias("is_node")))
    triplets = F.array(F.struct(F.lit("a").alias("s"), F.lit("http://e/schema#has").alias("p"), F.lit("b").alias("o")))
    text = F.concat(F.lit("ASK { "), F.when(k % 4 == 0, F.concat(F.lit("<"), "entity", F.lit(">"))).otherwise("?x"), F.lit(" <http://e/schema#"), F.when(k % 2 == 0, "has").otherwise("other"), F.lit("> ?y }"))
    valid = evaluate.validate_by_type(kind, path, triplets, F.array("answer"), F.when(k % 3 == 0, "literal").otherwise("uri"), text, r"http://e/part/[^>]+", r"http://e/schema#[^>]+")
    return o.join(p, o["o_orderkey"] == p["l_orderkey"]).select(k.alias("question_id"), kind.alias("query_type"), valid.alias("valid"))


@query("""SELECT event_type, CASE WHEN contains(upper(event_type), 'VIEW') THEN 'VIEW' END IS NULL AS other, CASE event_type WHEN 'x' THEN 'y' ELSE 'Other' END AS category FROM (SELECT DISTINCT event_type FROM events)""", graph=False)
def error_categories(spark, d):
    kinds = table(spark, d, "events").select("event_type").distinct()
    return kinds.select("event_type", (~F.contains(F.upper("event_type"), F.lit("VIEW"))).alias("other"), evaluate.error_category(F.upper("event_type")).alias("category"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 9 = 0 THEN 'NO_SUBGRAPH_EXTRACTION' WHEN o_orderkey % 4 = 0 THEN 'NO_FILTERED_SEEDS' WHEN o_orderkey % 3 = 0 THEN 'NO_MERGED_GRAPHS' WHEN o_orderstatus = 'O' THEN NULL WHEN o_orderstatus = 'F' THEN 'TIMEOUT' ELSE 'UNEXPECTED_ERROR' END AS code FROM orders""", graph=False)
def failure_codes(spark, d):
    k, s = F.col("o_orderkey"), F.col("o_orderstatus")
    outcome = F.when(s == "O", "ok").when(s == "F", "timeout").otherwise("crash")
    return table(spark, d, "orders").select(k.alias("id"), evaluate.failure_code(k % 9 != 0, k % 4, k % 3, outcome).alias("code"))


@query("""SELECT count(*) AS successes, count(CASE WHEN lower(o_orderpriority) = CASE WHEN o_orderkey % 3 = 0 THEN lower(o_orderpriority) ELSE 'x' END THEN 1 END) AS exact, round_even(avg(CASE WHEN o_orderkey % 3 = 0 THEN 1.0 ELSE 0.0 END), 4) AS rate FROM orders WHERE o_orderstatus <> 'F'""", graph=False)
def exact_match_rate(spark, d):
    rows = table(spark, d, "orders").select(F.concat(F.lit(" "), F.upper("o_orderpriority"), F.lit("\n")).alias("a"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).otherwise("x").alias("b"), (F.col("o_orderstatus") != "F").alias("ok"))
    return evaluate.exact_match_rate(rows, "a", "b", "ok")


@query("""WITH g AS (SELECT o_custkey AS question_id, o_totalprice AS pr, o_orderstatus = 'F' AS v, max(o_totalprice) OVER (PARTITION BY o_custkey) AS best, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders)
SELECT question_id, count(*) AS graphs, count(CASE WHEN v THEN 1 END) AS valuable, count(CASE WHEN v AND pr >= 150000 THEN 1 END) AS kept_absolute, count(CASE WHEN v AND pr >= 0.5 * best THEN 1 END) AS kept_relative, count(CASE WHEN v AND n <= 3 THEN 1 END) AS kept_top FROM g GROUP BY question_id""", graph=False)
def golden_content(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("question_id"), F.col("o_orderkey").alias("place"), F.col("o_totalprice").alias("probability"), (F.col("o_orderstatus") == "F").alias("valuable"))
    return evaluate.golden_content(rows, 150000.0, 0.5, 3)


@query("SELECT o_custkey AS question_id, count(*) AS n_before, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS n_after, round_even(1 - count(CASE WHEN o_orderstatus = 'F' THEN 1 END) / CAST(count(*) AS DOUBLE), 4) AS reduction FROM orders GROUP BY o_custkey", graph=False)
def merge_reduction(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("question_id"), "o_orderstatus")
    return merge.reduction(rows, rows.where("o_orderstatus = 'F'"))


@query("SELECT o_orderkey AS id, o_orderpriority AS query_type FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus = 'O'", graph=False)
def stage_rows(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("query_type"), F.when(F.col("o_orderstatus") != "O", "done").alias("generated"))
    return evaluate.stage_rows(rows, "generated", ["1-URGENT", "2-HIGH"]).select("id", "query_type")


# ---------------------------------------------------------------- rows that the queries above leave out


def _orders_by_year(kind: str) -> str:
    """Orders with the years of their customers' orders."""
    return f"(SELECT a.s AS o, CAST(b.o AS INT) AS y, {kind}(CAST(b.o AS INT)) OVER (PARTITION BY a.o) AS m FROM {_t('a', PLACED)} JOIN {_t('b', YEAR)} ON a.s = b.s)"


sparql("sparql_exists_correlated", "SELECT ?o WHERE { ?o sc:placedBy ?c ; sc:yearOf ?y FILTER EXISTS { ?p sc:placedBy ?c ; sc:yearOf ?z FILTER(?z > ?y) } }", f"SELECT o FROM {_orders_by_year('max')} WHERE m > y")
sparql("sparql_not_exists_correlated", "SELECT ?o WHERE { ?o sc:placedBy ?c ; sc:yearOf ?y FILTER NOT EXISTS { ?p sc:placedBy ?c ; sc:yearOf ?z FILTER(?z > ?y) } }", f"SELECT o FROM {_orders_by_year('max')} WHERE m = y")
sparql("sparql_not_exists_status", 'SELECT ?o ?c WHERE { ?o sc:placedBy ?c FILTER NOT EXISTS { ?o sc:status "F" } }', f"SELECT a.s AS o, a.o AS c FROM {_t('a', PLACED)} JOIN {_t('b', STATUS)} ON a.s = b.s WHERE b.o <> 'F'")
sparql("sparql_optional_filter", "SELECT ?o ?p WHERE { ?o sc:placedBy ?c ; sc:yearOf ?y ; sc:status \"P\" OPTIONAL { ?p sc:placedBy ?c ; sc:yearOf ?z FILTER(?z > ?y) } }", f"SELECT x.o, y.o AS p FROM (SELECT a.s AS o, a.o AS c, CAST(b.o AS INT) AS y FROM {_t('a', PLACED)} JOIN {_t('b', YEAR)} ON a.s = b.s JOIN {_t('d', STATUS)} ON a.s = d.s WHERE d.o = 'P') x LEFT JOIN (SELECT a.s AS o, a.o AS c, CAST(b.o AS INT) AS y FROM {_t('a', PLACED)} JOIN {_t('b', YEAR)} ON a.s = b.s) y ON x.c = y.c AND y.y > x.y")
sparql("sparql_optional_then_join", "SELECT ?x ?r ?l WHERE { ?x a ?t FILTER(?t IN (sc:Region, sc:Nation)) OPTIONAL { ?x sc:inRegion ?r } ?r rdfs:label ?l }", f"SELECT x.x, l.s AS r, l.o AS l FROM (SELECT a.s AS x, b.o AS r FROM {_t('a', TYPE)} LEFT JOIN {_t('b', IN_REGION)} ON a.s = b.s WHERE a.o IN ('{SC}Region', '{SC}Nation')) x JOIN {_t('l', LABEL)} ON x.r = l.s UNION ALL SELECT a.s, l.s, l.o FROM {_t('a', TYPE)} JOIN {_t('l', LABEL)} ON true WHERE a.o = '{SC}Region'")
sparql("sparql_minus_unbound", "SELECT ?x ?r WHERE { ?x a ?t FILTER(?t IN (sc:Region, sc:Nation)) OPTIONAL { ?x sc:inRegion ?r } MINUS { ?r rdfs:label \"ASIA\" } }", f"SELECT a.s AS x, b.o AS r FROM {_t('a', TYPE)} LEFT JOIN {_t('b', IN_REGION)} ON a.s = b.s WHERE a.o IN ('{SC}Region', '{SC}Nation') AND (b.o IS NULL OR b.o NOT IN (SELECT s FROM {_t('l', LABEL)} WHERE o = 'ASIA'))")

_SCORED = _SETS.removesuffix(" FROM m)") + """,
  CASE WHEN NOT generated_ok THEN 0.0 WHEN NOT golden_ok THEN NULL WHEN x = 0 THEN 1.0 WHEN y = 0 OR c = 0 THEN 0.0 ELSE round_even(2 * (CAST(c AS DOUBLE) / y) * (CAST(c AS DOUBLE) / x) / (CAST(c AS DOUBLE) / y + CAST(c AS DOUBLE) / x), 4) END AS f1,
  CASE WHEN generated_ok AND golden_ok AND x > 0 AND y > 0 THEN c = x AND c = y END AS exact_match FROM m)"""


@query(f"WITH {_SCORED} SELECT question_id, f1, exact_match FROM e", graph=False)
def nine_case_f1(spark, d):
    return _compared(spark, d).select("question_id", "f1", "exact_match")


@query(f"WITH {_SCORED} SELECT coalesce(query_type, 'ALL') AS query_type, round(avg(f1), 3) AS mean_f1 FROM e GROUP BY ROLLUP (query_type)", graph=False)
def mean_f1_by_query_type(spark, d):
    types = table(spark, d, "orders").select(F.col("o_orderkey").alias("question_id"), F.col("o_orderpriority").alias("query_type"))
    rows = _compared(spark, d).join(types, "question_id")
    return evaluate.stats_by_type(rows).select("query_type").join(rows.rollup("query_type").agg(F.round(F.avg("f1"), 3).alias("mean_f1")).withColumn("query_type", F.coalesce("query_type", F.lit("ALL"))), "query_type")


_CODES = ("CORRECT_EQUIVALENT", "EXECUTION_FAILURE", "EXTRA_CONSTRAINT", "MISSING_CONSTRAINT", "MISSING_NEGATION", "MISSING_UNION", "WRONG_ENTITY_URI", "WRONG_RELATION", "WRONG_VARIABLE", "WRONG_QUERY_TYPE", "JUDGE_ERROR")
_NAMES = ("Correct Equivalent", "Execution Failed", "Over-Constrained", "Under-Constrained", "Missing Negation", "Missing OR Logic", "Wrong Entity URI", "Wrong Predicate", "Wrong Variable", "Wrong Query Type", "Other")


def _coded(spark, d):
    codes = F.array(*(F.lit(c) for c in _CODES))
    return table(spark, d, "orders").select(F.col("o_orderpriority").alias("query_type"), F.get(codes, (F.col("o_orderkey") % len(_CODES)).cast("int")).alias("failure_code"))


@query("WITH r AS (SELECT o_orderpriority AS query_type, [" + ", ".join(f"'{c}'" for c in _CODES) + f"][o_orderkey % {len(_CODES)} + 1] AS failure_code, [" + ", ".join(f"'{c}'" for c in _NAMES) + f"][o_orderkey % {len(_CODES)} + 1] AS category FROM orders), n AS (SELECT coalesce(query_type, 'ALL') AS query_type, failure_code, category, count(*) AS n FROM r GROUP BY GROUPING SETS ((query_type, failure_code, category), (failure_code, category))) SELECT query_type, failure_code, category, n, round_even(n / CAST(sum(n) OVER (PARTITION BY query_type) AS DOUBLE), 4) AS share FROM n", graph=False)
def failure_code_histogram(spark, d):
    return evaluate.failure_histogram(_coded(spark, d))


@query("SELECT 'entity_' || (row_number() OVER (ORDER BY u.degree DESC, u.uri) - 1) AS id, u.uri, CASE WHEN t.k IS NULL THEN lower(trim(translate(regexp_replace(split_part(u.uri, '#', -1), '([a-z])([A-Z])', '\\1 \\2', 'g'), '_-', '  '))) WHEN t.k = 'Order' THEN 'Order: ' || split_part(u.uri, '/', -1) ELSE t.k || ': ' || coalesce(lab.label, '') END AS description FROM (SELECT s AS uri, count(*) AS degree FROM triples GROUP BY s) u LEFT JOIN (SELECT s, split_part(o, '#', 2) AS k FROM triples WHERE p = '" + TYPE + "') t ON t.s = u.uri LEFT JOIN lab ON lab.uri = u.uri WHERE u.uri NOT LIKE '%placedBy'")
def compile_entity_descriptions(spark, d):
    made = vectors.compile_entities(kg(spark, d), vectors.HashingEncoder(8), None).where(~F.col("uri").endswith("placedBy"))
    return made.select("id", "uri", "description")


@query("""WITH o AS (SELECT o_custkey, o_orderkey, round(o_totalprice / 600000, 6) AS score, o_orderkey % 3 = 0 AS near, o_orderkey % 5 = 0 AS alike FROM orders)
SELECT CAST(o_custkey AS VARCHAR) AS entity_from, string_agg('u' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0'), '|' ORDER BY o_orderkey) AS uris FROM o WHERE (near AND score < 0.5) OR (NOT near AND alike) GROUP BY o_custkey""", graph=False)
def citable_mentions(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("entity_from"), F.concat(F.lit("u"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0")).alias("entity_uri"), F.round(F.col("o_totalprice") / 600000, 6).alias("score"), F.when(F.col("o_orderkey") % 3 == 0, "semantic").otherwise("keyword").alias("source"), F.when(F.col("o_orderkey") % 5 == 0, F.col("o_custkey").cast("string")).otherwise(F.concat(F.lit("item "), "o_orderpriority")).alias("label"))
    return search.citable(rows, 0.5, 0.999).select("entity_from", F.array_join("uris", "|").alias("uris"))


@query("SELECT DISTINCT trim(c_mktsegment) || chr(1) || trim(CAST(c_nationkey AS VARCHAR)) AS key FROM customer", graph=False)
def answer_row_sets(spark, d):
    return evaluate.row_set(table(spark, d, "customer").select(F.col("c_nationkey").alias("z"), F.concat(F.lit(" "), "c_mktsegment", F.lit("  ")).alias("a")))


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 4 <> 0 ORDER BY o_orderkey LIMIT 500", graph=False)
def first_valid_questions(spark, d):
    text = F.when(F.col("o_orderkey") % 4 == 0, "SELECT ?x WHERE {").otherwise(F.concat(F.lit("SELECT ?x WHERE { ?x <http://x/p> \""), F.col("o_orderkey").cast("string"), F.lit("\" }")))
    return evaluate.first_sample(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), text.alias("golden_sparql")), 500).select("id")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'boolean=true' WHEN o_orderkey % 3 = 1 THEN 'x=' || o_custkey ELSE 'old=' || o_orderstatus END AS answer FROM orders", graph=False)
def live_or_stored_answers(spark, d):
    k = F.col("o_orderkey")
    row = lambda name, v: F.array(F.create_map(F.lit(name), F.struct(F.lit("literal").alias("type"), v.cast("string").alias("value"))))
    found = evaluate.live_or_stored(F.when(k % 3 == 0, True), F.when(k % 3 == 1, row("x", F.col("o_custkey"))), row("old", F.col("o_orderstatus")))
    entry = F.element_at(F.map_entries(F.element_at(found, 1)), 1)
    return table(spark, d, "orders").select(k.alias("id"), F.concat(entry["key"], F.lit("="), entry["value"]["value"]).alias("answer"))


@query()
def filter_seeds_word_ratio(spark, d):
    return filters.filter_seeds(_seeds(spark, d)).select("question_id", "entity_from", "entity_uri", F.round("fuzzy_score", 6).alias("fuzzy_score"))


@query()
def subgraph_search_whole(spark, d):
    """Best-first growth from every nation with the default settings, hops and paths."""
    g, encoder = kg(spark, d), vectors.HashingEncoder()
    seeds = g.triples.where((F.col("p") == TYPE) & (F.col("o") == SC + "Nation")).select(F.col("s").alias("seed_uri"))
    seeds = seeds.withColumn("question_id", F.element_at(F.split("seed_uri", "/"), -1))
    templates = seeds.select("question_id", encoder.encode(F.concat(F.lit("nation customer placed order "), "question_id")).alias("template"))
    relations = seeds.select("question_id", F.lit(SC + "placed").alias("relation_uri"))
    found = paths.subgraphs(g, seeds, templates, relations, encoder)
    return found.select("question_id", "seed_uri", merge.labelled_triples(F.col("triplets"), F.col("path")).alias("triples"), F.round("probability", 6).alias("probability"), "path_depth", "place")


# Two steps from every supplier: a seed set whose paths SQL can count, with the number of paths by relations for each seed.
_TWO = f""", s AS (SELECT s AS seed FROM triples WHERE p = '{TYPE}' AND o = '{SC}Supplier'),
e AS (SELECT s AS a, p AS r, o AS b FROM triples WHERE starts_with(o, 'http') UNION SELECT t.o, coalesce(inv.inv, t.p), t.s FROM triples t LEFT JOIN inv ON inv.p = t.p WHERE starts_with(t.o, 'http')),
f AS (SELECT * FROM e WHERE r = '{SC}inNation'),
one AS (SELECT s.seed, f.b AS n1 FROM s JOIN f ON f.a = s.seed)
SELECT one.seed AS seed_uri, e.r AS relation, e.b AS neighbor FROM one JOIN e ON e.a = one.n1 WHERE e.b <> one.seed AND e.b <> one.n1 AND e.r <> '{TYPE}'"""


@query(_TWO)
def path_expand_from_suppliers(spark, d):
    g = kg(spark, d)
    start = g.triples.where((F.col("p") == TYPE) & (F.col("o") == SC + "Supplier")).select(F.col("s").alias("seed_uri"), F.array("s").alias("nodes"))
    one = paths.candidates(g, start, [SC + "inNation"]).select("seed_uri", F.concat("nodes", F.array("neighbor")).alias("nodes"))
    return paths.candidates(g, one).where(F.col("relation") != TYPE).select("seed_uri", "relation", "neighbor")


_WORD = "split_part(p_name, ' ', 1) || CASE p_partkey % 5 WHEN 0 THEN 'ed' WHEN 1 THEN 'ing' WHEN 2 THEN 'ted' WHEN 3 THEN 'ying' ELSE 'ting' END"


@query(f"""WITH w AS (SELECT DISTINCT {_WORD} AS w FROM part),
b AS (SELECT w, CASE WHEN ends_with(w, 'ed') THEN CASE WHEN length(w) > 4 AND substr(w, -3, 1) = substr(w, -4, 1) AND substr(w, -4, 1) NOT IN ('a', 'e', 'i', 'o', 'u') THEN left(w, -3) WHEN substr(w, -3, 1) IN ('h', 'r', 't') THEN left(w, -2) ELSE left(w, -1) END
  WHEN ends_with(w, 'ing') THEN CASE WHEN length(w) > 4 AND substr(w, -4, 1) = substr(w, -5, 1) THEN left(w, -4) ELSE left(w, -3) END ELSE w END AS base FROM w)
SELECT w AS word, base, base || '|' || CASE WHEN ends_with(base, 'e') THEN base || 'd' WHEN ends_with(base, 'y') AND length(base) > 2 AND substr(base, -2, 1) NOT IN ('a', 'e', 'i', 'o', 'u') THEN left(base, -1) || 'ied' ELSE base || 'ed' END || '|' || CASE WHEN ends_with(base, 'e') AND length(base) > 2 THEN left(base, -1) ELSE base END || 'ing' AS forms FROM b""", graph=False)
def verb_words(spark, d):
    words = table(spark, d, "part").select(F.expr(_WORD).alias("word")).distinct()
    base = T.verb_base(F.col("word"))
    return words.select("word", base.alias("base"), F.array_join(T.verb_forms(base), "|").alias("forms"))


@query("SELECT p_partkey, array_to_string([x for x in regexp_extract_all(lower(p_name || ' of the ' || p_type || ', as 2 or an X'), '\\b([a-z]+)\\b', 1) if length(x) > 2 AND x NOT IN (" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + ")], '|') AS terms FROM part", graph=False)
def name_terms(spark, d):
    text = F.concat("p_name", F.lit(" of the "), "p_type", F.lit(", as 2 or an X"))
    return table(spark, d, "part").select("p_partkey", F.array_join(T.terms_of(text), "|").alias("terms"))
