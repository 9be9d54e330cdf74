"""N-Triples reading and writing (IO3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.graph import KnowledgeGraph
from kgloom.model import XSD

LINE = r'^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:\^\^<[^>]*>|@[A-Za-z0-9-]+)?)\s*\.\s*(?:#.*)?$'


def _unescaped(text: Column) -> Column:
    """String escapes of N-Triples; \\u escapes are rare and go through a JSON string."""
    simple = F.replace(F.replace(F.replace(F.replace(F.replace(text, F.lit("\\\\"), F.lit("\x00")), F.lit("\\n"), F.lit("\n")), F.lit("\\t"), F.lit("\t")), F.lit("\\r"), F.lit("\r")), F.lit('\\"'), F.lit('"'))
    coded = F.from_json(F.concat(F.lit('{"v":"'), text, F.lit('"}')), "v string")["v"]
    return F.when(F.contains(text, F.lit("\\u")), F.coalesce(coded, text)).otherwise(F.replace(simple, F.lit("\x00"), F.lit("\\")))


def parse_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Triples of a column of N-Triples lines; comments and broken lines go."""
    part = lambda i: F.regexp_extract(column, LINE, i)
    rows = lines.where(F.col(column).rlike(LINE)).select(part(1).alias("s"), part(2).alias("p"), part(3).alias("o"))
    body = F.regexp_extract("o", r'^"((?:[^"\\]|\\.)*)"', 1)
    kind = F.when(F.startswith("o", F.lit("<")), "uri").when(F.startswith("o", F.lit("_:")), "bnode").otherwise("literal")
    datatype = F.nullif(F.regexp_extract("o", r'"\^\^<([^>]*)>$', 1), F.lit(""))
    return rows.select(F.btrim("s", F.lit("<>")).alias("s"), "p", F.when(kind == "literal", _unescaped(body)).otherwise(F.btrim("o", F.lit("<>"))).alias("o"), kind.alias("o_kind"), F.nullif(datatype, F.lit(XSD + "string")).alias("o_datatype"), F.nullif(F.regexp_extract("o", r'"@([A-Za-z0-9-]+)$', 1), F.lit("")).alias("o_lang"))


def read_ntriples(spark: SparkSession, path: str) -> KnowledgeGraph:
    """A graph from N-Triples files; repeated triples count once."""
    return KnowledgeGraph(parse_lines(spark.read.text(path)).distinct())


def write_ntriples(kg: KnowledgeGraph, path: str) -> None:
    quoted = F.concat(F.lit('"'), F.replace(F.replace(F.replace(F.replace(F.replace("o", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")), F.lit("\t"), F.lit("\\t")), F.lit('"'), F.when(F.col("o_lang").isNotNull(), F.concat(F.lit("@"), "o_lang")).when(F.col("o_datatype").isNotNull(), F.concat(F.lit("^^<"), "o_datatype", F.lit(">"))).otherwise(""))
    term = lambda c: F.when(F.startswith(c, F.lit("_:")), F.col(c)).otherwise(F.concat(F.lit("<"), c, F.lit(">")))
    kg.triples.select(F.concat_ws(" ", term("s"), term("p"), F.when(F.col("o_kind") == "literal", quoted).otherwise(term("o")), F.lit(".")).alias("value")).write.text(path)


def write_parquet(kg: KnowledgeGraph, path: str) -> None:
    """Triples partitioned by predicate, so constant predicates prune files; subjects sorted within."""
    kg.triples.repartition("p", F.pmod(F.xxhash64("s"), F.lit(64))).sortWithinPartitions("p", "s").write.partitionBy("p").parquet(path)


def read_parquet(spark: SparkSession, path: str) -> KnowledgeGraph:
    return KnowledgeGraph(spark.read.parquet(path).select("s", "p", "o", "o_kind", "o_datatype", "o_lang"))
