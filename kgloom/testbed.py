"""A knowledge graph over the star-schema tables, as triples in Spark and as the same CTEs for DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.graph import KnowledgeGraph
from kgloom.model import OWL_INVERSE, RDF_TYPE, RDFS_LABEL, XSD
from kgloom.session import new_path

KG = "http://kg.example/"
SC = KG + "schema#"
PREFIXES = {"kg": KG, "sc": SC, "rdf": RDF_TYPE.rpartition("#")[0] + "#", "rdfs": RDFS_LABEL.rpartition("#")[0] + "#", "owl": OWL_INVERSE.rpartition("#")[0] + "#", "xsd": XSD}

_ENTITIES = (("region", "r_regionkey", "r_name", "Region"), ("nation", "n_nationkey", "n_name", "Nation"), ("customer", "c_custkey", "c_name", "Customer"), ("supplier", "s_suppkey", "s_name", "Supplier"), ("part", "p_partkey", "p_name", "Part"), ("orders", "o_orderkey", None, "Order"))
#: relation, table, subject entity and key, object entity and key
_EDGES = (("inNation", "customer", "customer", "c_custkey", "nation", "c_nationkey"), ("inNation", "supplier", "supplier", "s_suppkey", "nation", "s_nationkey"), ("inRegion", "nation", "nation", "n_nationkey", "region", "n_regionkey"), ("placedBy", "orders", "order", "o_orderkey", "customer", "o_custkey"), ("containsPart", "lineitem", "order", "l_orderkey", "part", "l_partkey"), ("suppliedBy", "lineitem", "part", "l_partkey", "supplier", "l_suppkey"))


def _uri(entity: str, key: str) -> str:
    return f"concat('{KG}{entity}/', {key})"


def triple_selects() -> list[str]:
    """SELECT statements, in the common part of both dialects, whose union (with repeats in lineitem) is the graph."""
    null = "CAST(NULL AS VARCHAR(1))"
    row = lambda s, p, o, kind, table, dt=null: f"SELECT {s} AS s, '{p}' AS p, {o} AS o, '{kind}' AS o_kind, {dt} AS o_datatype, {null} AS o_lang FROM {table}"
    out = []
    for table, key, name, kind in _ENTITIES:
        entity = "order" if table == "orders" else table
        out.append(row(_uri(entity, key), RDF_TYPE, f"'{SC}{kind}'", "uri", table))
        if name:
            out.append(row(_uri(entity, key), RDFS_LABEL, name, "literal", table))
    for relation, table, a, ka, b, kb in _EDGES:
        out.append(row(_uri(a, ka), SC + relation, _uri(b, kb), "uri", table).replace("SELECT ", "SELECT DISTINCT " if table == "lineitem" else "SELECT ", 1))
    out.append(row(_uri("order", "o_orderkey"), SC + "yearOf", "CAST(year(o_orderdate) AS VARCHAR(10))", "literal", "orders", f"'{XSD}gYear'"))
    out.append(row(_uri("order", "o_orderkey"), SC + "status", "o_orderstatus", "literal", "orders"))
    out.append(row(_uri("customer", "c_custkey"), SC + "segment", "c_mktsegment", "literal", "customer"))
    out.append(f"SELECT '{SC}placedBy' AS s, '{OWL_INVERSE}' AS p, '{SC}placed' AS o, 'uri' AS o_kind, {null} AS o_datatype, {null} AS o_lang")
    return out


#: For DuckDB: triples(s, p, o, o_kind, o_datatype, o_lang), lab(uri, label), inv(p, inv).
CTE = (
    "WITH triples AS (\n" + "\nUNION ALL ".join(triple_selects()) + "\n),\n"
    f"lab AS (SELECT s AS uri, min(o) AS label FROM triples WHERE p = '{RDFS_LABEL}' GROUP BY s),\n"
    f"inv AS (SELECT s AS p, min(o) AS inv FROM triples WHERE p = '{OWL_INVERSE}' GROUP BY s)"
)


_STORED: dict[tuple[str, str], str] = {}


def build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The triples, computed from the tables; each predicate is one narrow scan of one table."""
    found: DataFrame | None = None
    tables = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
    for table in tables:
        spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(f"_kg_{table}")
    for text in triple_selects():
        if " DISTINCT " in text:  # of the keys, before they are long texts; unlike keys have unlike URIs
            keys = ", ".join(dict.fromkeys(re.findall(r"\bl_\w+", text)))
            text = text.replace(" DISTINCT ", " ", 1).replace("FROM lineitem", f"FROM (SELECT DISTINCT {keys} FROM lineitem)")
        for table in tables:
            text = text.replace(f"FROM {table}", f"FROM _kg_{table}")
        rows = spark.sql(text)
        rows = rows.select(*(F.col(c).cast("string").alias(c) for c in rows.columns))
        found = rows if found is None else found.unionByName(rows)
    for table in tables:
        spark.catalog.dropTempView(f"_kg_{table}")
    return found


def graph(spark: SparkSession, sf_dir: str) -> KnowledgeGraph:
    """The graph, written once for each application and folder as Parquet by predicate: a constant predicate prunes files,
    and the two distinct shuffles of lineitem are done once."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORED:
        path = new_path(spark, "graph")
        build(spark, sf_dir).write.partitionBy("p").parquet(path)
        _STORED[key] = path
    columns = "s string, o string, o_kind string, o_datatype string, o_lang string, p string"
    triples = spark.read.schema(columns).parquet(_STORED[key]).select("s", "p", "o", "o_kind", "o_datatype", "o_lang")
    return KnowledgeGraph(triples)
