"""Question files, CSV lists, logs and reports (IO4 to IO13, IO15)."""

from __future__ import annotations

import logging
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.model import QUESTIONS, ValidationError


def load_schema_text(spark: SparkSession, path: str, most: int = 60_000) -> str:
    """IO4: a schema file's text, cut at ``most`` characters with a note."""
    text = spark.read.text(path, wholetext=True).head()[0]
    return text if len(text) <= most else text[:most] + "\n# [TRUNCATED]"


def read_jsonl(spark: SparkSession, path: str, schema: str = QUESTIONS) -> DataFrame:
    """IO5: one record for each line that is not blank."""
    return spark.read.schema(schema).json(path).na.drop("all")


def read_json_or_jsonl(spark: SparkSession, path: str, schema: str = QUESTIONS) -> DataFrame:
    """IO6: a whole-file list or object, else records by line."""
    first = spark.read.text(path).where("trim(value) != ''").head()
    if first is None:
        return spark.createDataFrame([], schema)
    text = first[0].strip()
    whole = text.startswith("[") or text == "{" or not text.endswith("}")
    return spark.read.schema(schema).option("multiLine", whole).json(path)


def write_jsonl(rows: DataFrame, path: str) -> None:
    """IO7: into a new path."""
    rows.write.json(path)


def append_new(rows: DataFrame, path: str, key: str = "id") -> DataFrame:
    """IO8: append the rows whose key is not in the output yet; bad lines there are skipped. Returns what was appended."""
    from kgloom.operators.vectors import exists
    from kgloom.session import checkpoint

    spark = rows.sparkSession
    if exists(spark, path):
        done = spark.read.schema(f"`{key}` string").option("mode", "DROPMALFORMED").json(path).where(F.col(key).isNotNull()).distinct()
        rows = rows.join(done, rows[key].cast("string") == done[key], "left_anti")
    new = checkpoint(rows)
    new.write.mode("append").json(path)
    return new


def read_benchmark(spark: SparkSession, questions: str, answers: str) -> DataFrame:
    """IO9: question records with their stored answers, by id."""
    kind = "map<string, struct<type: string, value: string>>"
    q = spark.read.schema("questions array<struct<id: string, query_type: string, question: struct<string: string>, paraphrased_question: struct<string: string>, query: struct<sparql: string>, entities: array<string>, relations: array<string>>>").option("multiLine", True).json(questions).select(F.explode("questions").alias("q")).select("q.*")
    a = spark.read.schema(f"answers array<struct<id: string, answer: struct<boolean: boolean, results: struct<bindings: array<{kind}>>>>>").option("multiLine", True).json(answers).select(F.explode("answers").alias("a")).select("a.id", F.col("a.answer.boolean").alias("b"), F.col("a.answer.results.bindings").alias("rows"))
    truth = F.array(F.create_map(F.lit("boolean"), F.struct(F.lit("boolean").alias("type"), F.col("b").cast("string").alias("value"))))
    answer = F.when(F.col("b").isNotNull(), truth).otherwise(F.coalesce("rows", F.array().cast(f"array<{kind}>")))
    forms = F.struct(F.col("question.string").alias("1"), F.col("paraphrased_question.string").alias("2"))
    return q.join(a, "id", "left").select("id", "query_type", forms.alias("question"), F.col("entities").alias("golden_entities"), F.col("relations").alias("golden_relations"), F.col("query.sparql").alias("golden_sparql"), answer.alias("answer"))


def read_csv(spark: SparkSession, path: str, required: tuple[str, ...]) -> DataFrame:
    """IO10, IO11: a CSV with a header; columns that are asked for must be there."""
    rows = spark.read.option("header", True).option("escape", '"').csv(path)
    if missing := [c for c in required if c not in rows.columns]:
        raise ValidationError(f"columns missing in {path}: {', '.join(missing)}")
    return rows


def read_entities(spark: SparkSession, path: str, described: bool = False) -> DataFrame:
    rows = read_csv(spark, path, ("entity", "description") if described else ("entity",))
    return rows.withColumn("degree", F.col("degree").try_cast("long")) if "degree" in rows.columns else rows


def read_relations(spark: SparkSession, path: str, described: bool = False) -> DataFrame:
    rows = read_csv(spark, path, ("relation", "description") if described else ("relation",))
    return rows.withColumn("count", F.col("count").try_cast("long")) if "count" in rows.columns else rows


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.option("header", True).option("escape", '"').csv(path)


def write_change_log(log: DataFrame, folder: str, kind: str, stamp: str) -> str:
    """IO12: (uri, description, status) of an upsert, under a time stamp."""
    path = f"{folder.rstrip('/')}/{kind}_changes_{stamp}"
    write_csv(log.withColumnRenamed("uri", f"{kind}_uri"), path)
    return path


def markdown(title: str, rows: DataFrame, most: int | None = None) -> str:
    """IO13: an aggregate (a row for each type or code) as a Markdown table; a table cut at ``most`` rows says so."""
    found = rows.collect() if most is None else rows.limit(most + 1).collect()
    more = most is not None and len(found) > most
    show = lambda v: "" if v is None else f"{v:.4f}".rstrip("0").rstrip(".") if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [f"# {title}", "", "| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns), *("| " + " | ".join(show(v) for v in r) + " |" for r in found[:most])]
    return "\n".join(lines) + (f"\n\nOnly the first {most} rows are shown." if more else "") + "\n"


def log_to(path: str, name: str = "kgloom") -> logging.Logger:
    """IO15: a logger that writes to the console and to a file."""
    logger = logging.getLogger(name)
    logger.setLevel(logging.INFO)
    for handler in (logging.StreamHandler(sys.stdout), logging.FileHandler(path, encoding="utf-8")):
        handler.setFormatter(logging.Formatter("%(asctime)s %(message)s"))
        logger.addHandler(handler)
    return logger
