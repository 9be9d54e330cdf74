"""Operator 5: I-Match fingerprints of documents and of their edited texts.

Terms are the lower-cased words of a text. One pass counts in how many documents each term occurs (per task first, so
that the shuffle carries a task's vocabulary, not its postings); a second keeps, of each text, the distinct terms whose
document frequency lies in a band, in sorted order, and hashes those that fall into each of several random subsets of
the lexicon. The band's lower edge is a share of all documents, so the lexicon has at most (mean distinct terms per
document) / share entries whatever the corpus size; it is broadcast for that reason, as 8 bytes an entry, after a check
of its size (beyond ``most_terms`` entries the operator stops and asks for a higher edge).

Subsets have several densities (a term is in subset i with probability 2^-d_i), so that short and long documents both
have subsets that hold a few of their terms. Likeness is, at the density where it is largest, the share of equal hashes
among the subsets that either text fills, for densities at which half of the subsets are filled; equal fingerprints have
likeness 1. A text without terms in the band is fingerprinted by a hash of its text, so different texts of this kind differ.

The edited text needs each document's successor by doc_id. Documents are dealt once into ranges of doc_id and text hash, each to
a task of its own; the first document of each range is also dealt to the range before it. Ties of doc_id are ordered by a hash of the text; null ids come first; the last
document's successor is the first one (itself, if alone).

Null text: empty. Repeated rows follow one another and are each other's successors. Empty table: empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.llm.common import Ranges, documents, id_and_text, id_array

#: A subset of density d holds one in 2^d terms of the lexicon; each density has EACH subsets.
LEVELS, EACH = (1, 3, 5, 7, 9, 11), 12
DENSITIES = tuple(d for d in LEVELS for _ in range(EACH))
LOW, HIGH = 0.0005, 0.2


def terms(text: str) -> set[bytes]:
    return set(text.lower().encode().split())


def term_hash(term: bytes) -> int:
    """A signed 64-bit hash."""
    from xxhash import xxh64_intdigest

    x = xxh64_intdigest(term, 5)
    return x - (1 << 64) if x >> 63 else x


def frequencies(rows: DataFrame) -> DataFrame:
    """(term, df): in how many rows of (text) each hashed term occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([term_hash(t) for t in seen], pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["term", "n"])
            seen.clear()
            return out

        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(terms(text))
                if len(seen) > 500_000:
                    yield flush()
        if seen:
            yield flush()

    return rows.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("df"))


def lexicon(rows: DataFrame, low: float, high: float) -> tuple[DataFrame, int]:
    """The terms (hashed) in the band, and the number of documents."""
    n = rows.count()
    return frequencies(rows).where(F.col("df").between(max(2, low * n), max(2, high * n))).select("term"), n


class Fingerprinter:
    """Hashes of the lexicon's random subsets; ``terms_of_band`` is a sorted array of hashed terms."""

    def __init__(self, terms_of_band):
        import numpy as np

        self.np, self.band = np, terms_of_band
        seeds = np.arange(1, len(DENSITIES) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        self.seeds = seeds
        self.cuts = np.array([(1 << (64 - d)) - 1 for d in DENSITIES], np.uint64)
        self.known = {}

    def hashes(self, text: str) -> list[int]:
        """64-bit hash of each subset's terms; 0 if it has none."""
        np, band, known = self.np, self.band, self.known
        from xxhash import xxh64_intdigest

        if len(known) > 400_000:
            known.clear()
        found = []
        for t in terms(text):
            h = known.get(t)
            if h is None:
                h = known[t] = term_hash(t)
            found.append(h)
        x = np.array(found, np.int64)
        if len(x):
            at = np.searchsorted(band, x)
            x = x[(at < len(band)) & (band[np.minimum(at, len(band) - 1)] == x)] if len(band) else x[:0]
        if not len(x):
            return [xxh64_intdigest(text.encode(), 7) | 1] * len(DENSITIES)
        x = np.sort(x).view(np.uint64)
        return self.of_sorted(x)

    def of_sorted(self, x) -> list[int]:
        """Each subset's hash: sorted distinct terms of the subset, mixed and summed so that any order gives the same."""
        np = self.np
        z = x[None, :] ^ self.seeds[:, None]
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
        held = z <= self.cuts[:, None]
        mixed = (z * np.uint64(0xD6E8FEB86659FD93)) ^ (z >> np.uint64(17))
        sums = np.where(held, mixed, np.uint64(0)).sum(1, dtype=np.uint64)
        return [int(s) | 1 if full else 0 for s, full in zip(sums.tolist(), held.any(1).tolist(), strict=True)]


def show(hashes: list[int]) -> str:
    return "".join(f"{h & 0xFFFFFFFF ^ h >> 32:08x}" if h else "-" * 8 for h in hashes)


def likeness(a: str, b: str) -> float:
    if a == b:
        return 1.0
    best = 0.0
    for at in range(0, len(a), 8 * EACH):
        pairs = [(a[i : i + 8], b[i : i + 8]) for i in range(at, at + 8 * EACH, 8)]
        filled = [x == y for x, y in pairs if x[0] != "-" or y[0] != "-"]
        if 2 * len(filled) >= EACH:
            best = max(best, sum(filled) / len(filled))
    return best


def edited(text: str, following: str) -> str:
    """The last half of the text gives way to as much of the following one (or all of it)."""
    n = len(text) // 2
    return text[: len(text) - n] + following[:n]


def successors(rows: DataFrame, parts: int) -> DataFrame:
    """rows (doc_id, text) dealt into ranges, sorted, with the first of each range also at the end of the range before.

    Columns: part, extra (true for the copied row), doc_id, tie, packed (the compressed text).
    """
    ranges = rows.sparkSession.sparkContext.broadcast(Ranges(rows, "doc_id", parts))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            key, tie = id_array(batch.column(0)), batch.column(1).to_numpy()
            part = ranges.value.of(key, tie)
            order = np.lexsort((tie, key, part))
            heads = order[np.r_[True, np.diff(part[order]) > 0]] if len(order) else order
            yield pa.RecordBatch.from_arrays([pa.array(x[heads]) for x in (part, key, tie)], names=["part", "key", "tie"])

    keyed = rows.select("doc_id", F.xxhash64("text").alias("tie"))
    heads = keyed.mapInArrow(first, "part long, key long, tie long").groupBy("part").agg(F.min(F.struct("key", "tie")).alias("k"))
    heads = sorted((r["part"], r["k"]["key"], r["k"]["tie"]) for r in heads.collect())  # one row for each range
    before = {(key, tie): heads[i - 1][0] for i, (_, key, tie) in enumerate(heads)}  # the first row's copy goes round to the last range
    before = rows.sparkSession.sparkContext.broadcast(before)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zstandard import ZstdCompressor

        pack = ZstdCompressor(level=3).compress
        for batch in batches:
            key, tie = id_array(batch.column(0)), batch.column(1).to_numpy()
            out = []
            for i, k, t, p, text in zip(batch.column(0).to_pylist(), key.tolist(), tie.tolist(), ranges.value.of(key, tie).tolist(), batch.column(2).to_pylist(), strict=True):
                data = pack(text.encode())
                out.append((p, False, i, t, data))
                if (to := before.value.get((k, t))) is not None:
                    out.append((to, True, i, t, data))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), DEALT, strict=True)], schema=DEALT)

    dealt = rows.select("doc_id", F.xxhash64("text").alias("tie"), "text").mapInArrow(deal, "part int, extra boolean, doc_id long, tie long, packed binary")
    return dealt.repartitionById(parts, "part").sortWithinPartitions("part", "extra", F.col("doc_id").asc_nulls_first(), "tie")


DEALT = pa.schema([("part", pa.int32()), ("extra", pa.bool_()), ("doc_id", pa.int64()), ("tie", pa.int64()), ("packed", pa.binary())])
OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(docs: DataFrame, low: float = LOW, high: float = HIGH, most_terms: int = 4_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: fingerprint, edited text's hash and fingerprint, and the likeness to the edited and to the next text."""
    import numpy as np

    spark = docs.sparkSession
    rows = id_and_text(docs, id_col, text_col)
    band, n = lexicon(rows, low, high)
    found = [r[0] for r in band.limit(most_terms + 1).toLocalIterator()] if n else []
    if len(found) > most_terms:
        raise ValueError(f"the band holds over {most_terms} terms: raise its lower edge")
    held = spark.sparkContext.broadcast(np.sort(np.array(found, np.int64)))
    parts = max(4, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        from zstandard import ZstdDecompressor

        maker, unpack, before, out = Fingerprinter(held.value), ZstdDecompressor().decompress, None, []

        def close(part, doc_id, text, print_, following, next_print):
            changed = edited(text, following)
            again = show(maker.hashes(changed))
            return doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), print_, again, likeness(print_, again), likeness(print_, next_print)

        for batch in batches:
            for part, extra, doc_id, _, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = unpack(data).decode()
                if extra and (before is None or before[0] != part):
                    continue  # a further copy of a row whose id repeats
                now = show(maker.hashes(text))
                if before is not None and before[0] == part:
                    out.append(close(*before, text, now))
                before = None if extra else (part, doc_id, text, now)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), OUT, strict=True)], schema=OUT)
                out = []

    return successors(rows, parts).mapInArrow(run, SCHEMA)


def op5_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir))


QUERIES = {"op5_imatch": op5_imatch}
SQL: dict[str, str] = {}
