"""The hand graph of the unit tests."""

from kgloom.graph import KnowledgeGraph
from kgloom.sources.rdf import parse_lines

EX, SC = "http://kg.example/", "http://kg.example/schema#"
PREFIXES = {"ex": EX, "sc": SC, "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "rdfs": "http://www.w3.org/2000/01/rdf-schema#", "xsd": "http://www.w3.org/2001/XMLSchema#"}
TYPE, LABEL, INVERSE = f"<{PREFIXES['rdf']}type>", f"<{PREFIXES['rdfs']}label>", "<http://www.w3.org/2002/07/owl#inverseOf>"

LINES = f"""
<{EX}a> {TYPE} <{SC}Person> .
<{EX}a> {LABEL} "Ann Lee" .
<{EX}b> {TYPE} <{SC}Person> .
<{EX}b> {LABEL} "Bob Ray" .
<{EX}p1> {TYPE} <{SC}Paper> .
<{EX}p1> {LABEL} "Graph Paths" .
<{EX}p1> <{SC}authoredBy> <{EX}a> .
<{EX}p1> <{SC}authoredBy> <{EX}b> .
<{EX}p1> <{SC}yearOfPublication> "2020"^^<http://www.w3.org/2001/XMLSchema#gYear> .
<{EX}p1> <{SC}publishedIn> "Venue X" .
<{EX}p2> {TYPE} <{SC}Paper> .
<{EX}p2> <{SC}authoredBy> <{EX}a> .
<{EX}p2> <{SC}yearOfPublication> "2015"^^<http://www.w3.org/2001/XMLSchema#gYear> .
<{SC}authoredBy> {INVERSE} <{SC}authorOf> .
<{EX}p2> <{SC}cites> <{EX}p1> .
# a comment
broken line
<{EX}a> {LABEL} "Ann Lee" .
"""


def hand_graph(spark, lines: str = LINES) -> KnowledgeGraph:
    rows = spark.createDataFrame([(x,) for x in lines.strip().split("\n")], "value string")
    return KnowledgeGraph(parse_lines(rows).distinct().coalesce(2).cache())
