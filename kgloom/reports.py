"""The four reports (IO13): of one query type, of all types, of the pipeline's stages, and a summary table.

All figures are aggregates (a row for each type or code); questions are only listed up to a stated number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.operators.evaluate import failure_histogram, stats_by_type
from kgloom.sources.files import markdown

LISTED = ("question_id", "state", "golden_count", "generated_count", "precision", "recall", "f1", "correct", "failure_code")


def _accuracy(states: DataFrame) -> DataFrame:
    """Share of correct questions and mean scores, by query type and for ALL."""
    made = [F.count("*").alias("questions"), F.bround(F.avg(F.coalesce("correct", F.lit(False)).cast("double")), 4).alias("accuracy"), *(F.bround(F.avg(c), 4).alias(f"mean_{c}") for c in ("precision", "recall", "f1"))]
    return states.rollup("query_type").agg(F.grouping("query_type").alias("_all"), *made).orderBy("_all", "query_type").withColumn("query_type", F.when(F.col("_all") == 1, "ALL").otherwise(F.col("query_type"))).drop("_all")


def type_report(states: DataFrame, query_type: str, listed: int = 500) -> str:
    """One type: numbers of its states, accuracy, failure codes and its first questions by id."""
    rows = states.where(F.col("query_type") == query_type)
    codes = failure_histogram(rows).where("query_type != 'ALL'").orderBy(F.desc("n"), "failure_code")
    return "\n".join([
        markdown(f"{query_type}: states", stats_by_type(rows, totals=False)),
        markdown("Accuracy", _accuracy(rows).where("query_type != 'ALL'")),
        markdown("Failure codes", codes),
        markdown("Questions", rows.select(*LISTED).orderBy("question_id"), listed),
    ])


def combined_report(states: DataFrame) -> str:
    """All types: states with a totals row, accuracy, failure codes by type, and their categories."""
    codes = failure_histogram(states)
    categories = codes.where("query_type = 'ALL'").groupBy("category").agg(F.sum("n").alias("n"), F.bround(F.sum("share"), 4).alias("share")).orderBy(F.desc("n"), "category")
    return "\n".join([
        markdown("All query types: states", stats_by_type(states).orderBy(F.col("query_type") == "ALL", "query_type")),
        markdown("Accuracy", _accuracy(states)),
        markdown("Failure codes", codes.orderBy("query_type", F.desc("n"), "failure_code")),
        markdown("Error categories", categories),
    ])


def summary_report(states: DataFrame) -> str:
    """A table with a row for each type: questions and states."""
    return markdown("Summary", stats_by_type(states).select("query_type", "total", "correct_0", "correct_1", "wrong_0", "wrong_1").orderBy(F.col("query_type") == "ALL", "query_type"))


def stage_counts(stages: dict[str, DataFrame], questions: DataFrame) -> DataFrame:
    """(query_type, questions, a column for each stage): how many rows each stage has; stages have a question_id."""
    rows = questions.select(F.col("id").alias("question_id"), "query_type")
    for name, stage in stages.items():
        n = stage.groupBy("question_id").agg(F.count("*").alias(name))
        rows = rows.join(n, "question_id", "left").fillna(0, [name])
    sums = [F.count("*").alias("questions"), *(F.sum(n).alias(n) for n in stages)]
    return rows.rollup("query_type").agg(F.grouping("query_type").alias("_all"), *sums).orderBy("_all", "query_type").withColumn("query_type", F.when(F.col("_all") == 1, "ALL").otherwise(F.col("query_type"))).drop("_all")


def golden_survival(questions: DataFrame, golden: str, before: DataFrame, after: DataFrame, uri: str) -> DataFrame:
    """One row: golden URIs of all questions, and how many a stage's input and output still have."""
    bare = F.btrim(F.col("u"), F.lit("<>"))
    wanted = questions.select(F.col("id").alias("question_id"), F.explode(golden).alias("u")).select("question_id", bare.alias(uri))
    hits = lambda rows: wanted.join(rows.select("question_id", uri).distinct(), ["question_id", uri], "left_semi").count()
    n = wanted.count()
    return questions.sparkSession.createDataFrame([(n, hits(before), hits(after))], "golden long, before long, after long")


def pipeline_report(stages: dict[str, DataFrame], questions: DataFrame) -> str:
    """Rows of each stage by query type, and the golden entities and relations that survive the filters."""
    parts = [markdown("Rows by stage", stage_counts(stages, questions))]
    for title, golden, before, after, uri in (("Golden entities", "golden_entities", "seeds", "filtered_seeds", "entity_uri"), ("Golden relations", "golden_relations", "relations", "filtered_relations", "relation_uri")):
        if golden in questions.columns and before in stages and after in stages:
            parts.append(markdown(title, golden_survival(questions, golden, stages[before], stages[after], uri)))
    return "\n".join(parts)
