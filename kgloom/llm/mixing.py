"""Operator 4: mixing sources to target weights by capped water-filling. DataFrame and SQL only.

Sources share a budget (a multiple of all words) in proportion to their weights; a source's target is capped at a multiple of its
own size, and what it cannot take goes to the others by weight until none is above its cap. With sources ordered by
cap / weight that is one pass: the level is (budget left) / (weight left) at the first source that it does not fill.

Each document is taken floor(target / source size) times whole. The fraction that is left of its source goes to documents in
a seeded random order (md5 of the seed and doc_id), each once more, until the words suffice; the last of them is taken in
part (its first words), so a source's taken words equal its rounded target, and no document is taken beyond its cap. The running sum over
this order is found in levels: rows that are equal in id, source and text count as one with a multiplicity; ids are summed in
256 x 256 cells by the leading hash digits, then within a cell; rows of one id (or none) in 1,024 cells by the hash of
their text, then within a cell. So no task orders a whole source, nor all rows of a repeated id. If all caps together
are below the budget, every source is at its cap.

Weights repeat over the sources in code point order, nulls last. Null text: size 0. Repeated rows are separate
documents; rows of one id are ordered by cell, size and hash of the text. An empty table gives an empty result, a source of
size 0 target 0. Columns of the input may have any names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgloom.llm.common import WORD, boxed, checkpoint, documents, stored, text_of

WEIGHTS = (5, 2, 1)
#: Copies of one row that a task makes at once.
CHUNK = 65_536


def target_steps(weights=WEIGHTS, share: float = 1.5, cap: float = 2.0) -> list[tuple[str, str]]:
    """SQL from sized (source, size) to targets (source, source_size, target); it runs on Spark and on DuckDB.

    The windows are over one row for each source.
    """
    weight = "CASE (place - 1) % " + str(len(weights)) + " " + " ".join(f"WHEN {i} THEN {float(w)!r}e0" for i, w in enumerate(weights)) + " END"
    return [
        ("sources", "SELECT source, sum(size) AS source_size FROM sized GROUP BY source"),
        ("placed", "SELECT source, source_size, row_number() OVER (ORDER BY CASE WHEN source IS NULL THEN 1 ELSE 0 END, source) AS place FROM sources"),
        ("weighed", f"SELECT source, source_size, place, {weight} AS w, {cap!r}e0 * source_size AS cap FROM placed"),
        ("ordered", "SELECT source, source_size, w, cap, place, row_number() OVER (ORDER BY cap / w, place) AS k, sum(source_size) OVER () AS everything FROM weighed"),
        ("summed", f"SELECT source, source_size, w, cap, k, {share!r}e0 * everything AS budget, coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0e0) AS filled, sum(w) OVER (ORDER BY k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS open FROM ordered"),
        ("level", "SELECT min(CASE WHEN (budget - filled) / open <= cap / w THEN k END) AS k FROM summed"),
        ("water", "SELECT (s.budget - s.filled) / s.open AS rate, s.k FROM summed s JOIN level l ON s.k = l.k"),
        ("targets", "SELECT s.source, CAST(s.source_size AS BIGINT) AS source_size, CASE WHEN x.k IS NULL OR s.k < x.k THEN s.cap ELSE x.rate * s.w END AS target FROM summed s LEFT JOIN water x ON 1 = 1"),
    ]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights, share: float, cap: float) -> DataFrame:
    """(source, source_size, target, whole, rest) from sized (source, size): whole repetitions and the words beyond them."""
    spark, mark = sized.sparkSession, uuid.uuid4().hex[:12]
    names = ["sized", *(n for n, _ in target_steps())]
    sized.createOrReplaceTempView(f"sized_{mark}")
    for name, text in target_steps(weights, share, cap):
        for other in names:
            for word in ("FROM", "JOIN"):
                text = text.replace(f"{word} {other} ", f"{word} {other}_{mark} ")
                if text.endswith(f"{word} {other}"):
                    text += f"_{mark}"
        found = spark.sql(text)
        if name == "sources":
            found = checkpoint(found)
        found.createOrReplaceTempView(f"{name}_{mark}")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)))).otherwise(0)
    targets = checkpoint(spark.table(f"targets_{mark}").withColumn("whole", whole).withColumn("rest", F.round("target").cast("long") - F.col("whole") * F.col("source_size")))
    for name in names:
        spark.catalog.dropTempView(f"{name}_{mark}")
    return targets


def _same(x: DataFrame, y: DataFrame, *more: str) -> list[Column]:
    return [x["source"].eqNullSafe(y["source"]), *(x[c] == y[c] for c in more)]


def _before(part: list[str], *by: str) -> Column:
    """The sum of n over the rows of the partition before this one."""
    return F.coalesce(F.sum("n").over(W.partitionBy(*part).orderBy(*by).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))


def plan(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, h, copies, source_size, target, whole, extra): a row for each distinct id, source and text (hash h).

    ``extra`` words are to be taken of its copies beyond ``whole`` repetitions of each.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(text_of(text_col)).alias("h"))
    u = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 16)
    rows = checkpoint(rows.groupBy("doc_id", "source", "size", "h").agg(F.count("*").alias("copies")).withColumn("u", u).withColumn("n", F.col("copies") * F.col("size")))
    targets = source_targets(rows.select("source", F.col("n").alias("size")), weights, share, cap)
    ids = checkpoint(rows.groupBy("source", "u").agg(F.sum("n").alias("n"), F.count("*").alias("texts")).withColumns({"a": F.substring("u", 1, 2), "b": F.substring("u", 3, 2)}))
    cells = checkpoint(ids.groupBy("source", "a", "b").agg(F.sum("n").alias("n")))
    high = cells.groupBy("source", "a").agg(F.sum("n").alias("n")).select("source", "a", _before(["source"], "a").alias("over_a"))
    low = cells.select("source", "a", "b", _before(["source", "a"], "b").alias("over_b"))
    offsets = low.join(high, _same(low, high, "a")).select(low["source"], low["a"], low["b"], (F.col("over_a") + F.col("over_b")).alias("over"))
    offsets = offsets.join(targets, _same(offsets, targets)).select(offsets["source"], "a", "b", "over", "source_size", "target", "whole", "rest")
    inside = ids.withColumn("prior", _before(["source", "a", "b"], "u"))
    placed = inside.join(offsets, _same(inside, offsets, "a", "b")).select(inside["source"], "u", "texts", "source_size", "target", "whole", (F.col("rest") - F.col("over") - F.col("prior")).alias("left"))
    columns = ["doc_id", rows["source"], "size", "h", "copies", "n", rows["u"], "texts", "source_size", "target", "whole", "left"]
    joined = rows.join(placed, _same(rows, placed, "u")).select(*columns)
    if not ids.where("texts > 1").isEmpty():  # rows of one id but of several texts
        joined = checkpoint(joined)
        many = joined.where("texts > 1").withColumn("c", F.pmod(F.col("h"), F.lit(1024)))
        parts = many.groupBy("source", "u", "c").agg(F.sum("n").alias("n"))
        parts = parts.select("source", "u", "c", _before(["source", "u"], "c").alias("over"))
        many = many.withColumn("prior", _before(["source", "u", "c"], "size", "h"))
        left = (F.col("left") - F.col("over") - F.col("prior")).alias("left")
        many = many.join(parts, _same(many, parts, "u", "c")).select(*(many[c] for c in joined.columns[:-1]), left)
        joined = joined.where("texts = 1").unionByName(many)
    extra = F.greatest(F.lit(0), F.least(F.col("n"), F.col("left"))).cast("long")
    return joined.select("doc_id", "source", "size", "h", "copies", "source_size", "target", "whole", extra.alias("extra"))


def _taken(copy: Column) -> Column:
    """The words taken of one of a row's copies, numbered from 0."""
    return (F.col("whole") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), F.col("extra") - copy * F.col("size")))).cast("long")


def mix(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken and source of every row of docs; options as those of plan."""
    found = plan(docs, **options)
    first = found.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(CHUNK).cast("long"))))
    each = first.withColumn("copy", F.explode(F.sequence(F.col("first"), F.least(F.col("first") + CHUNK, F.col("copies")) - 1)))
    return each.select("doc_id", "size", "source_size", "target", _taken(F.col("copy")).alias("taken"), "source")


def numbered(rows: DataFrame, *keys: str) -> DataFrame:
    """rows with ``copy``, their number from 0 among those of equal keys. Each task's share of a key is numbered apart."""
    held = stored(rows.withColumn("at", F.monotonically_increasing_id()), "numbered")  # stored, so that numbers stay
    held = held.withColumn("task", F.shiftrightunsigned("at", 33))
    counts = held.groupBy(*keys, "task").agg(F.count("*").alias("n"))
    counts = counts.select(*(F.col(k).alias(f"k_{k}") for k in keys), F.col("task").alias("k_task"), _before(list(keys), "task").alias("over"))
    inside = held.withColumn("place", F.row_number().over(W.partitionBy(*keys, "task").orderBy("at")) - 1)
    match = [inside[k].eqNullSafe(counts[f"k_{k}"]) for k in (*keys, "task")]
    return inside.join(counts, match).select(*rows.columns, (F.col("place") + F.col("over")).cast("long").alias("copy"))


def mixed_rows(docs: DataFrame, text_col: str = "text", count_col: str = "n_chars", id_col: str = "doc_id", source_col: str = "source", **options) -> DataFrame:
    """docs as the mix takes them: a row for each whole repetition and one with the first words of a part repetition.

    ``count_col``, where it is a column, gets the number of code points. Rows are known by id, source and text; a row
    without words stays once.
    """
    found = plan(docs, text_col=text_col, id_col=id_col, source_col=source_col, **options)
    found = stored(found.select(F.col("doc_id").alias("p_id"), F.col("source").alias("p_source"), F.col("h").alias("p_h"), "size", "copies", "whole", "extra"), "plan")
    rows = boxed(docs, doc_id=F.col(id_col).cast("long"), source=F.col(source_col).cast("string"), h=F.xxhash64(text_of(text_col)))
    match = [rows["doc_id"].eqNullSafe(found["p_id"]), rows["source"].eqNullSafe(found["p_source"]), rows["h"] == found["p_h"]]
    joined = rows.join(found, match)
    shown = ["row", "size", "whole", "extra", "copy"]
    each = joined.where("copies = 1").withColumn("copy", F.lit(0).cast("long")).select(*shown)
    if not found.where("copies > 1").isEmpty():
        each = each.unionByName(numbered(joined.where("copies > 1"), "doc_id", "source", "h").select(*shown))
    times = F.sequence(F.lit(0).cast("long"), F.floor(F.col("taken") / F.nullif(F.col("size"), F.lit(0))))
    parts = F.filter(F.transform(times, lambda i: F.least(F.col("size"), F.col("taken") - i * F.col("size"))), lambda n: n > 0)
    each = each.withColumn("taken", _taken(F.col("copy"))).withColumn("words", F.explode(F.when(F.col("size") == 0, F.array(F.lit(0).cast("long"))).otherwise(parts)))
    text = F.col("row").getField(text_col)
    part = F.when(F.col("words") < F.col("size"), F.array_join(F.slice(F.regexp_extract_all(text, F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0)), 1, F.col("words").cast("int")), ""))
    each = each.withColumn("part", part)
    changed = {text_col: F.coalesce("part", text)}
    if count_col in docs.columns:
        changed[count_col] = F.when(F.col("part").isNotNull(), F.length("part").cast(docs.schema[count_col].dataType)).otherwise(F.col("row").getField(count_col))
    return each.select(*(changed.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as the mix takes them, repetitions as rows; see mixed_rows."""
    return mixed_rows(docs)


QUERIES = {"op4_mixing": op4_mixing}
SQL = {
    "op4_mixing": "WITH sized AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size, left(md5('0:' || CAST(doc_id AS VARCHAR)), 16) AS u FROM documents),\n"
    + ",\n".join(f"{n} AS ({t})" for n, t in target_steps())
    + """,
reps AS (SELECT source, source_size, target, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM targets),
rests AS (SELECT *, CAST(round(target) AS BIGINT) - whole * source_size AS rest FROM reps),
runs AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY u, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior FROM sized)
SELECT r.doc_id, r.size, t.source_size, t.target, CAST(t.whole * r.size + greatest(0, least(r.size, t.rest - r.prior)) AS BIGINT) AS taken, r.source FROM runs r JOIN rests t ON r.source IS NOT DISTINCT FROM t.source"""
}
