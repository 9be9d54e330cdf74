"""Operator 8: quality classifier by a sparse rule ensemble.

Statistics of each text (lengths, shares of character classes, repetition of words, lines and word triples, how well it
compresses) are computed once where the text is read. Small boosted trees are grown on a bounded sample of labelled rows
(``train_rows``, the rows of least hash of their id); every path from a root to a node is a rule, a conjunction of
bounds on statistics. A logistic model with an L1 penalty weighs rules and (clipped, scaled) statistics; its strength is
chosen on a fifth of the sample. The rules with weight become one Spark column expression, so scoring is a projection.

Only rows whose crc32(doc_id as text) mod 3 is not 1 are used for fitting, and only their statistics.

The fit runs in one task, on the bounded sample alone; the driver gets the fitted rules. ``good_rows`` writes rows and
statistics once and reads them back twice, so texts are scanned by Python once and never shuffled.

Nulls and edge cases: a null text is empty and scored like any other; a null doc_id is not held out and never labelled; repeated
labels of a document count as their majority (ties: 1); without labels of both classes the score is the smoothed share of
label 1. Repeated rows are returned each. An empty table gives an empty result. Columns of the input may have any names.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.llm.common import boxed, checkpoint, documents, narrow_batches, stored, table, text_of

STATS = ("log_words", "log_chars", "word_chars", "upper", "digits", "symbols", "bars", "stops", "high", "lines", "line_words", "same_lines", "same_words", "same_triples", "top_word", "short_words", "long_words", "upper_words", "symbol_words", "packed")
KIND = pa.struct([(n, pa.float64()) for n in STATS])
UPPER, DIGITS, STOPS = bytes(range(65, 91)), b"0123456789", b".,;:?"
SYMBOLS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:?'-")
HIGH = bytes(range(128, 256))


def statistics(text: str) -> list[float]:
    """The values of STATS for a text; an empty one has zeros."""
    import math
    from collections import Counter
    from itertools import islice

    raw = text.encode()
    if not raw:
        return [0.0] * len(STATS)
    words, lines = raw.split(), [x for x in text.split("\n") if x.strip()]
    n, size, m = max(1, len(words)), len(raw), max(1, len(lines))
    share = lambda kind: (size - len(raw.translate(None, kind))) / size
    counts = Counter(words)
    triples = len(set(zip(words, islice(words, 1, None), islice(words, 2, None))))
    lengths = list(map(len, words))
    return [
        math.log1p(len(words)), math.log1p(size), sum(lengths) / n, share(UPPER), share(DIGITS), share(SYMBOLS), raw.count(b"|") / n, share(STOPS), share(HIGH), len(lines) / n,
        n / m, 1 - len(set(lines)) / m, 1 - len(counts) / n, 1 - triples / max(1, len(words) - 2), max(counts.values(), default=0) / n,
        sum(x <= 3 for x in lengths) / n, sum(x > 15 for x in lengths) / n, sum(map(bytes.isupper, words)) / n, sum(w.translate(None, SYMBOLS) != w for w in words) / n, len(zlib.compress(raw, 1)) / size,
    ]


def stats_column(text: Column) -> Column:
    """A struct of STATS for a text column."""

    def run(texts: pa.Array) -> pa.Array:
        rows = [statistics(t or "") for t in texts.to_pylist()]
        return pa.StructArray.from_arrays([pa.array(c, pa.float64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.float64())] * len(STATS), names=list(STATS))

    kind = "struct<" + ", ".join(f"{n}: double" for n in STATS) + ">"
    return F.arrow_udf(run, kind).asNondeterministic()(text)  # not evaluated twice by a filter pushed below


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string").cast("binary")) % 3 == 1, F.lit(False))


class Trees:
    """Boosted regression trees of little depth over binned statistics; what they are grown for is their paths."""

    def __init__(self, x, y, trees: int = 48, depth: int = 3, rate: float = 0.3, seed: int = 1):
        import numpy as np

        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, 33)[1:-1])) for c in x.T]
        self.bins = np.stack([np.searchsorted(c, v, "left") for c, v in zip(self.cuts, x.T, strict=True)], 1)
        self.rules: dict[tuple, None] = {}
        rng, f, n = np.random.default_rng(seed), np.zeros(len(y)), len(y)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-f))
            rows = rng.permutation(n)[: max(2, n * 6 // 10)]
            step = np.zeros(n)
            self.grow(rows, np.arange(n), y - p, p * (1 - p), step, (), depth)
            f += rate * step

    def grow(self, rows, every, g, h, step, path, depth) -> None:
        import numpy as np

        if path:
            self.rules.setdefault(path)
        total_g, total_h = g[rows].sum(), h[rows].sum() + 1
        best = (1e-6, None, None)
        if depth and len(rows) >= 10:
            for j, cuts in enumerate(self.cuts):
                if len(cuts):
                    left_g = np.cumsum(np.bincount(self.bins[rows, j], g[rows], len(cuts) + 1))[:-1]
                    left_h = np.cumsum(np.bincount(self.bins[rows, j], h[rows], len(cuts) + 1))[:-1]
                    n = np.cumsum(np.bincount(self.bins[rows, j], minlength=len(cuts) + 1))[:-1]
                    gain = left_g**2 / (left_h + 1) + (total_g - left_g) ** 2 / (total_h - left_h) - total_g**2 / total_h
                    gain[(n < 5) | (len(rows) - n < 5)] = 0
                    if gain.max() > best[0]:
                        best = (gain.max(), j, int(gain.argmax()))
        if best[1] is None:
            step[every] = total_g / total_h
            return
        _, j, k = best
        for side in (True, False):
            bound = (j, side, float(self.cuts[j][k]))
            kept = [b for b in path if b[:2] != bound[:2]] + [bound]  # a later bound on the same side is the tighter
            pick = lambda r: r[(self.bins[r, j] <= k) == side]
            self.grow(pick(rows), pick(every), g, h, step, tuple(sorted(kept)), depth - 1)


def matches(rule: tuple, x):
    import numpy as np

    out = np.ones(len(x), bool)
    for j, below, cut in rule:
        out &= (x[:, j] <= cut) == below
    return out


def lasso_logistic(a, y, penalty: float, start=None, rounds: int = 400):
    """Weights (the last one a free constant) by accelerated proximal gradient steps."""
    import numpy as np

    a = np.ascontiguousarray(np.hstack([a, np.ones((len(a), 1))]))
    # einsum stays on one thread: BLAS threads wait for one another for most of their time on matrices of this size
    out, back = (lambda x: np.einsum("ij,j->i", a, x)), (lambda x: np.einsum("ij,i->j", a, x))
    w = np.zeros(a.shape[1]) if start is None else start.copy()
    v, t = w.copy(), 1.0
    probe = np.ones(a.shape[1])
    for _ in range(12):  # the largest eigenvalue, for the step
        probe = back(out(probe))
        probe /= np.linalg.norm(probe) or 1.0
    size = 4 * len(a) / max(1e-9, float(np.linalg.norm(back(out(probe))))) / 1.05
    for _ in range(rounds):
        new = v - size * back(1 / (1 + np.exp(-np.clip(out(v), -40, 40))) - y) / len(a)
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - size * penalty, 0)
        t, before = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        moved = float(np.abs(new - w).max())
        v, w = new + (before - 1) / t * (new - w), new
        if moved < 1e-4:
            break
    return w


class Rules:
    """A fitted ensemble: rules and clipped statistics with their weights."""

    def __init__(self, x, y):
        import numpy as np

        x, y = np.asarray(x, float).reshape(-1, len(STATS)), np.asarray(y, float)
        self.rules, self.weights, self.linear = [], [], []
        self.constant = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        if len(y) < 20 or y.min() == y.max():
            return
        rules = list(Trees(x, y).rules)
        low, high = np.quantile(x, 0.025, 0), np.quantile(x, 0.975, 0)
        spread = np.clip(x, low, high).std(0)
        used = np.flatnonzero(spread > 1e-9)
        hits = np.stack([matches(r, x) for r in rules], 1).astype(np.float32) if rules else np.zeros((len(x), 0), np.float32)
        rules_kept = np.flatnonzero((hits.mean(0) > 0.002) & (hits.mean(0) < 0.998))
        _, first = np.unique(hits[:, rules_kept], axis=1, return_index=True)
        rules_kept = rules_kept[np.sort(first)]
        share = hits[:, rules_kept].mean(0)
        scale = np.sqrt(share * (1 - share))
        a = np.hstack([hits[:, rules_kept].astype(float) / scale, 0.4 * (np.clip(x, low, high)[:, used] - low[used]) / spread[used]])
        check = np.arange(len(y)) % 5 == 4
        best, start, found = None, None, None
        for penalty in (0.03, 0.015, 0.008, 0.004, 0.002, 0.001):
            start = lasso_logistic(a[~check], y[~check], penalty, start)
            z = np.clip(np.einsum("ij,j->i", a[check], start[:-1]) + start[-1], -40, 40)
            loss = float(np.mean(np.log1p(np.exp(-z * (2 * y[check] - 1)))))
            if best is None or loss < best - 1e-4:
                best, found = loss, penalty
        w = lasso_logistic(a, y, found, start)
        n = len(rules_kept)
        self.constant = float(w[-1])
        for i, k in enumerate(rules_kept):
            if abs(w[i]) > 1e-6:
                self.rules.append(rules[k])
                self.weights.append(float(w[i] / scale[i]))
        for i, j in enumerate(used):
            if abs(w[n + i]) > 1e-6:
                self.linear.append((int(j), float(low[j]), float(high[j]), float(0.4 * w[n + i] / spread[j])))

    def to_json(self) -> str:
        return json.dumps([self.constant, self.rules, self.weights, self.linear])

    @classmethod
    def from_json(cls, text: str) -> Rules:
        found = cls.__new__(cls)
        found.constant, rules, found.weights, linear = json.loads(text)
        found.rules, found.linear = [tuple(map(tuple, r)) for r in rules], [tuple(x) for x in linear]
        return found

    def scores(self, x):
        import numpy as np

        x = np.asarray(x, float).reshape(-1, len(STATS))
        z = np.full(len(x), self.constant)
        for rule, w in zip(self.rules, self.weights, strict=True):
            z += w * matches(rule, x)
        for j, low, high, w in self.linear:
            z += w * (np.clip(x[:, j], low, high) - low)
        return 1 / (1 + np.exp(-z))

    def column(self, stats: str) -> Column:
        """The score as an expression over a struct column of STATS."""
        name = lambda j: f"`{stats}`.`{STATS[j]}`"
        number = lambda v: f"CAST('{v!r}' AS DOUBLE)"
        terms = [number(self.constant)]
        for rule, w in zip(self.rules, self.weights, strict=True):
            held = " AND ".join(f"{name(j)} {'<=' if below else '>'} {number(cut)}" for j, below, cut in rule)
            terms.append(f"IF({held}, {number(w)}, 0D)")
        terms += [f"{number(w)} * (least(greatest({name(j)}, {number(low)}), {number(high)}) - {number(low)})" for j, low, high, w in self.linear]
        return F.expr(f"1D / (1D + exp(-({' + '.join(terms)})))")


def training_rows(stats: DataFrame, labels: DataFrame, most: int, label_col: str = "quality") -> DataFrame:
    """At most ``most`` labelled rows that are not held out: those of least hash, then least id."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("y")).where("y IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.when(F.avg("y") >= 0.5, 1.0).otherwise(0.0).alias("y"))
    rows = checkpoint(stats.where(~held_out(F.col("doc_id"))).join(marks, "doc_id"))
    n = rows.count()
    if n > 2 * most:  # all but about as many rows as are wanted go before any task sends rows on
        cut = int(1.2 * most / n * 2**64) - 2**63
        some = rows.where(F.xxhash64("doc_id") <= cut)
        rows = some if some.count() >= most else rows
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def fit(stats: DataFrame, labels: DataFrame, train_rows: int = 8000, label_col: str = "quality") -> Rules:
    """Fit on stats (doc_id, stats) and labels, in one task; of all rows only the sample goes there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        held = [np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], 1) for b in batches if b.num_rows]
        if held:
            x = np.concatenate(held)
            x = x[np.lexsort(x.T[::-1])]  # the same fit whatever order the rows come in
            x = x[np.random.default_rng(2).permutation(len(x))]
            yield pa.RecordBatch.from_arrays([pa.array([Rules(x[:, :-1], x[:, -1]).to_json()])], names=["rules"])

    rows = training_rows(stats, labels, train_rows, label_col).select("stats.*", "y").coalesce(1)
    found = rows.mapInArrow(run, "rules string").head()
    return Rules.from_json(found["rules"]) if found else Rules([], [])


def document_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    narrow_batches(docs.sparkSession)
    return checkpoint(docs.select(F.col(id_col).cast("long").alias("doc_id"), stats_column(text_of(text_col)).alias("stats")))


def quality_scores(docs: DataFrame, labels: DataFrame, train_rows: int = 8000) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs."""
    stats = document_stats(docs)
    scored = stats.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), fit(stats, labels, train_rows).column("stats").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def good_rows(docs: DataFrame, labels: DataFrame, train_rows: int = 8000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose text scores 0.5 or more, as they are, whatever their columns are called."""
    narrow_batches(docs.sparkSession)
    rows = stored(boxed(docs, doc_id=F.col(id_col).cast("long"), stats=stats_column(text_of(text_col))), "scored")
    rules = fit(rows.select("doc_id", "stats"), labels, train_rows)
    return rows.where(rules.column("stats") >= 0.5).select("row.*")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of good quality; null and empty texts are judged like any other, and repeated rows each."""
    return good_rows(docs, table(spark, sf_dir, "labels"))


QUERIES = {"op8_quality": op8_quality}
SQL: dict[str, str] = {}
