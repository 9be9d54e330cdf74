"""Adaptive filters of seeds and relations (A1 to A5) and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kgloom.functions.text import fuzzy_label_score, strip_brackets

#: best score below -> (largest gap, most rows); fixed values
SEED_LADDER = ((0.15, 0.05, 2), (0.25, 0.06, 2), (0.35, 0.05, 3), (None, 0.04, 2))
RELATION_LADDER = ((0.15, 0.10, 1), (0.25, 0.15, 2), (0.35, 0.15, 2), (None, 0.15, 3))


def _ladder(best: Column, steps, part: int) -> Column:
    found = None
    for step in steps[:-1]:
        found = (F if found is None else found).when(best < step[0], F.lit(step[part]))
    return found.otherwise(F.lit(steps[-1][part]))


def _adaptive(rows: DataFrame, keys: list[str], score: str, order: list[Column], steps) -> DataFrame:
    """Rows whose gap to the first row's score is under the ladder's bound, in order, up to its number."""
    w = W.partitionBy(*keys).orderBy(*order)
    best = rows.withColumn("_best", F.first(score).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))).withColumn("_place", F.row_number().over(w))
    kept = best.where(F.col(score) - F.col("_best") < _ladder(F.col("_best"), steps, 1))
    numbered = kept.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy("_place")))
    return numbered.where(F.col("_n") <= _ladder(F.col("_best"), steps, 2)).drop("_best", "_place", "_n")


def filter_seeds(seeds: DataFrame, keys: tuple[str, ...] = ("question_id",), fuzzy: bool = True, exact: bool = True) -> DataFrame:
    """A1: per question and mention, by label likeness then score; literals are dropped. Adds fuzzy_score."""
    rows = seeds.where(~F.coalesce(F.array_contains("entity_types", "Literal"), F.lit(False)))
    rows = rows.withColumn("fuzzy_score", fuzzy_label_score(F.col("label"), F.col("entity_from"), exact) if fuzzy else F.lit(0.0))
    return _adaptive(rows, [*keys, "entity_from"], "score", [F.desc("fuzzy_score"), F.asc("score"), F.asc("entity_uri")], SEED_LADDER)


def filter_relations(relations: DataFrame, keys: tuple[str, ...] = ("question_id",), fuzzy: bool = False, exact: bool = True) -> DataFrame:
    """A2: per question and phrase, by distance (or label likeness first)."""
    order = [F.asc("distance"), F.asc("relation_uri")]
    if fuzzy:
        relations = relations.withColumn("fuzzy_score", fuzzy_label_score(F.col("label"), F.col("relation_from"), exact))
        order = [F.desc("fuzzy_score"), *order]
    return _adaptive(relations, [*keys, "relation_from"], "distance", order, RELATION_LADDER)


def dedup_by_types(relations: DataFrame, keys: tuple[str, ...] = ("question_id",), position: str = "pos") -> DataFrame:
    """A3: of the phrases with one set of types only the first stays, with all its rows; position gives the order."""
    rows = relations.withColumn("_types", F.array_join(F.array_sort("relation_types"), "\x01"))
    first = rows.groupBy(*keys, "_types").agg(F.min_by("relation_from", position).alias("_first"))
    return rows.join(first, [*keys, "_types"]).where(F.col("relation_from") == F.col("_first")).drop("_types", "_first")


def rename_types(types: Column, names: dict[str, str] | None = None) -> Column:
    """A4: types by other names."""
    names = names or {"authorOf": "authoredBy"}
    table = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    return F.transform(types, lambda t: F.coalesce(F.element_at(table, t), t))


def coverage(golden: Column, found: Column) -> Column:
    """How many golden entries (repeats count) are among the found ones."""
    marked = lambda a, asked: F.transform(F.coalesce(a, F.array().cast("array<string>")), lambda x: F.struct(strip_brackets(x).alias("x"), F.lit(asked).alias("asked")))
    # In order, a golden entry comes after the found ones like it: one pass after a sort, however long both lists are.
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("n"))
    step = lambda s, e: F.when(e["asked"], F.struct(s["last"].alias("last"), (s["n"] + F.when(e["x"] == s["last"], 1).otherwise(0)).alias("n"))).otherwise(F.struct(e["x"].alias("last"), s["n"].alias("n")))
    return F.aggregate(F.array_sort(F.concat(marked(golden, True), marked(found, False))), start, step, lambda s: s["n"])


def coverage_stats(rows: DataFrame, golden: str, before: str, after: str) -> DataFrame:
    """A5: per row golden, before, after, lost, reduction (percent of rows dropped) and PASS or FAIL (something golden was lost)."""
    rows = rows.withColumns({"covered_before": coverage(F.col(golden), F.col(before)), "covered_after": coverage(F.col(golden), F.col(after))})  # each is computed once
    n_before, n_after = F.col("covered_before"), F.col("covered_after")
    cut = 1 - F.size(after) / F.nullif(F.size(before), F.lit(0))
    shown = [c for c in rows.columns if c not in ("covered_before", "covered_after")]
    return rows.select(*shown, F.size(golden).alias("n_golden"), n_before, n_after, (n_before - n_after).alias("lost"), F.coalesce(F.format_string("%.2f%%", cut * 100), F.lit("0.00%")).alias("reduction"), F.when(n_before == n_after, "PASS").otherwise("FAIL").alias("verdict"))
