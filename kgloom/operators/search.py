"""Keyword, semantic and hybrid search of entities (K1 to K8)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kgloom.functions.text import fuzzy_match, search_variants, seed_label
from kgloom.graph import KnowledgeGraph
from kgloom.model import RDF_TYPE, SearchMode
from kgloom.operators.vectors import search_entities
from kgloom.session import limited, stored


def keyword_search(kg: KnowledgeGraph, keywords: DataFrame, limit: int = 10, variants: bool = False, type_prefix: str | None = None, most: int = 10_000) -> DataFrame:
    """K1, K2: (query_id, entity_uri, label, rank): entities whose label holds a keyword, by label and URI.

    keywords (query_id, name[, types]): blank names find nothing. With variants any form of the name counts. With type_prefix an
    entity must be of the prefix and the first of the keyword's types. Keywords go to every label task, after a check
    of their number (beyond ``most`` they are searched in blocks); a task keeps the first ``limit`` of each keyword.
    """
    name = F.trim(F.col("name"))
    forms = search_variants(F.col("name")) if variants else F.array(F.lower(name))
    asked = keywords.where(F.coalesce(name, F.lit("")) != "").withColumn("forms", forms)
    typed = type_prefix is not None and "types" in keywords.columns
    kind = F.when(F.size("types") > 0, F.concat(F.lit(type_prefix), F.get("types", F.lit(0)))) if typed else F.lit(None).cast("string")
    asked = asked.select("query_id", "forms", kind.alias("wanted"))
    n = asked.limit(most + 1).count()
    blocks = 1 if n <= most else 1 + asked.count() // most
    found = None
    for i in range(blocks):
        part = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)
        low = kg.labels.withColumn("low", F.lower("label"))
        hits = low.join(F.broadcast(part), F.exists("forms", lambda f: F.contains(F.col("low"), f)))
        if typed:
            types = kg.triples.where(F.col("p") == RDF_TYPE).select(F.col("s").alias("uri"), F.col("o").alias("wanted"))
            hits = hits.where("wanted IS NULL").unionByName(hits.join(types, ["uri", "wanted"], "left_semi"))
        found = hits if found is None else found.unionByName(hits)
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("label", "uri"))).where(F.col("rank") <= limit)
    return ranked.select("query_id", F.col("uri").alias("entity_uri"), "label", "rank")


def keyword_search_each(kg: KnowledgeGraph, keywords: DataFrame, limit: int = 10, timeout: float | None = 25.0, **options) -> tuple[DataFrame, dict[str, str]]:
    """K2: keyword_search within ``timeout`` seconds, and the error of each query_id that failed.

    All keywords are searched in one plan; only if that fails is each searched alone, with the same limit, so that one that
    fails or takes too long costs its own result only. The result is stored.
    """
    spark = keywords.sparkSession
    search = lambda asked: stored(keyword_search(kg, asked, limit, **options), "keywords")
    ok, found, _ = limited(spark, lambda: search(keywords), timeout)
    if ok:
        return found, {}
    parts, errors = [], {}
    for r in keywords.select("query_id").distinct().toLocalIterator():
        ok, found, error = limited(spark, lambda r=r: search(keywords.where(F.col("query_id") == r["query_id"])), timeout)
        if ok:
            parts.append(found)
        else:
            errors[r["query_id"]] = error
    if not parts:
        return spark.createDataFrame([], "query_id string, entity_uri string, label string, rank int"), errors
    joined = parts[0]
    for more in parts[1:]:
        joined = joined.unionByName(more)
    return joined, errors


def shares(n: int, mode: SearchMode = SearchMode.hybrid) -> tuple[int, int]:
    """How many of n results are semantic and how many by keyword: two thirds (rounded half to even) in hybrid mode."""
    if mode == SearchMode.hybrid:
        semantic = round(n * 0.6666)
        return semantic, n - semantic
    return (n, 0) if mode == SearchMode.semantic else (0, n)


def hybrid(semantic: DataFrame, keyword: DataFrame, n: int, mode: SearchMode = SearchMode.hybrid) -> DataFrame:
    """K3: semantic results first, then keyword results (score 0), each URI once, at most n of a query.

    semantic: query_id, entity_uri, label, description, distance, rank; keyword: query_id, entity_uri, label, rank.
    """
    n_semantic, n_keyword = shares(n, mode)
    a = semantic.where(F.col("rank") <= n_semantic).select("query_id", "entity_uri", "label", F.lit("semantic").alias("source"), F.col("distance").alias("score"), "description", F.lit(0).alias("_s"), "rank")
    b = keyword.where(F.col("rank") <= n_keyword).select("query_id", "entity_uri", "label", F.lit("keyword").alias("source"), F.lit(0.0).alias("score"), F.lit(None).cast("string").alias("description"), F.lit(1).alias("_s"), "rank")
    once = a.unionByName(b).withColumn("_n", F.row_number().over(W.partitionBy("query_id", "entity_uri").orderBy("_s", "rank"))).where("_n = 1")
    placed = once.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy("_s", "rank", "entity_uri")))
    return placed.where(F.col("place") <= n).drop("_s", "_n", "rank")


def seed_nodes(kg: KnowledgeGraph, mentions: DataFrame, collection: DataFrame, encoder, n: int = 3, mode: SearchMode = SearchMode.hybrid, type_prefix: str | None = None) -> DataFrame:
    """K5: seeds of mentions (query_id, name, types) with entity_from and entity_types; all mentions in one plan."""
    n_semantic, n_keyword = shares(n, mode)
    near = search_entities(collection, mentions, encoder, max(1, n_semantic)).withColumn("label", seed_label(F.col("description"), F.col("entity_uri")))
    words = keyword_search(kg, mentions, max(1, n_keyword), type_prefix=type_prefix)
    found = hybrid(near, words, n, mode)
    return found.join(mentions.select("query_id", F.col("name").alias("entity_from"), F.col("types").alias("entity_types")), "query_id")


def citable(seeds: DataFrame, similarity: float, fuzzy: float) -> DataFrame:
    """K6: (entity_from, uris): semantic hits below the distance, keyword hits above the likeness; no row if none."""
    near = (F.col("source") == "semantic") & (F.col("score") < similarity)
    alike = (F.col("source") == "keyword") & (fuzzy_match(F.col("label"), F.col("entity_from")) > fuzzy)
    return seeds.where(near | alike).groupBy("entity_from").agg(F.array_sort(F.collect_set("entity_uri")).alias("uris"))
