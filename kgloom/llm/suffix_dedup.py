"""Operator 1: repeated passages by a sparse suffix array over words.

A passage counts as repeated if its ``min_words`` words, compared exactly, also stand elsewhere: in another document or
at another place of the same one. White space between words may differ.

1. Sparse: of every ``min_words`` window the place of the least hash among its first ``window`` word k-grams (leftmost if
   tied) is kept. Equal windows keep the same place, so whatever is repeated shares a kept suffix, and all words from it
   to the window's end, at least ``min_words - window + 1``.
2. Thin out: the kept suffixes, keyed by a hash of that many words, are sorted over the whole corpus in ranges (equal keys
   may span ranges, so a passage in a third of all documents still spreads), and each is compared with its neighbours.
   Suffixes that are alone are dropped. The first and last of a range stay, since their neighbour is in another range.
3. Sort and extend: what is left travels once more, with its words on both sides as far as a window reaches, to the task of
   its key. There the suffixes are put in the order of their words, read rightwards, and in that of the words before them, read
   leftwards; the longest common prefixes of neighbours in both orders say how far any two of them match to the right and to
   the left. A window is repeated if another suffix matches on both sides as far as the window reaches. (The
   neighbour with the longest match on one side need not be the one with the longest match on both, so both orders count.)
   Words themselves are compared, not hashes.
4. Repeated windows of a document that overlap join to maximal spans.

Suffixes of which there are over ``most`` are not brought together: their windows are hashed (128 bits), which finds the same
ones. Documents with such suffixes are dealt over blocks, of some ``BLOCK`` suffixes each; a block counts and looks up each distinct
window once, however many of its documents have it.

Exact copies are collapsed before step 3 by a 96-bit hash of the text: the copy with the least doc_id stands for all, the
others are one span if they have ``min_words`` words, and so is the first, as a kept one (``whole`` marks these spans). The
first occurrence of a window (least doc_id, then place) is marked kept. ``without_repeats`` cuts the other spans out, except words
that are also in a kept one, so that every passage stays somewhere.

Nulls and edge cases: a null or short text has no spans; null ids come before all others. Rows that repeat both doc_id and
text are one document. An empty table gives an empty result. Texts are processed whole. Columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.llm.common import WORD, boxed, documents, id_and_text, stored, text_of

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)


def mixed(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int, held={}):  # noqa: B006
    import numpy as np

    if base not in held or len(held[base]) < n:
        p = np.full(max(n, 4096), np.uint64(base))
        p[0] = 1
        held[base] = np.multiply.accumulate(p)
    return held[base][:n]


def word_places(text: str):
    """(starts, stops): code points where the words of a text begin and end."""
    import numpy as np

    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    inside = np.zeros(len(points) + 2, np.int8)
    inside[1:-1] = (points != 32) & ((points < 9) | (points > 13))
    steps = np.diff(inside)
    return np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)


class Words:
    """Hashes of all word n-grams of a text."""

    def __init__(self, text: str):
        import numpy as np
        from xxhash import xxh64_intdigest

        self.words = text.encode().split()
        self.n = len(self.words)
        hashes = np.fromiter(map(xxh64_intdigest, self.words), np.uint64, self.n)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(hashes * _powers(BASE, self.n), out=self.sums[1:])
        self.down = _powers(INVERSE, self.n + 1)

    def grams(self, size: int):
        """Hash of the size words from each place on."""
        return mixed((self.sums[size:] - self.sums[: self.n + 1 - size]) * self.down[: self.n + 1 - size])

    def kept(self, min_words: int, window: int, size: int):
        """For each window of min_words words its kept place."""
        import numpy as np

        n = self.n - min_words + 1
        g = self.grams(size)[: n + window - 1]
        return np.arange(n) + np.lib.stride_tricks.sliding_window_view(g, window).argmin(1)


def _signed(x):
    import numpy as np

    return pa.array(x.view(np.int64))


def suffixes(rows: DataFrame, min_words: int, window: int, size: int) -> DataFrame:
    """(suffix, h, m, at): the kept suffixes of rows (h, m, text); a text that a task has just had is skipped."""
    length = min_words - window + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        had: set = set()
        for batch in batches:
            keys, hs, ms, ats = [], [], [], []
            for h, m, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (h, m) in had:
                    continue
                if len(had) > 500_000:
                    had.clear()
                had.add((h, m))
                words = Words(text)
                if words.n < min_words:
                    continue
                at = np.unique(words.kept(min_words, window, size))
                keys.append(words.grams(length)[at])
                ats.append(at)
                hs.append(np.full(len(at), h, np.int64))
                ms.append(np.full(len(at), m, np.int32))
            if keys:
                yield pa.RecordBatch.from_arrays([_signed(np.concatenate(keys)), pa.array(np.concatenate(hs)), pa.array(np.concatenate(ms)), pa.array(np.concatenate(ats).astype(np.int32))], names=["suffix", "h", "m", "at"])

    return rows.select("h", "m", "text").mapInArrow(run, "suffix long, h long, m int, at int")


def shared_suffixes(found: DataFrame, parts: int) -> DataFrame:
    """(suffix, h, m, at) of the suffixes that equal a neighbour in sorted order, or that end a range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        held, waiting, first = None, False, True  # the last row, whether it is known to be shared, whether the range has just begun
        for batch in batches:
            rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if not len(rows[0]):
                continue
            if held is not None:
                rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
            new = np.ones(len(rows[0]), bool)
            new[1:] = np.any([x[1:] != x[:-1] for x in rows], axis=0)
            rows = [x[new] for x in rows]
            same, out = rows[0][1:] == rows[0][:-1], np.zeros(len(rows[0]), bool)
            out[1:] |= same
            out[:-1] |= same
            out[0] |= waiting | first
            held, waiting, first = [x[-1:] for x in rows], bool(out[-1]), False
            out[-1] = False
            if out.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[out]) for x in rows], names=cols)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], names=cols)

    cols = ["suffix", "h", "m", "at"]
    return found.repartitionByRange(parts, *cols).sortWithinPartitions(*cols).mapInArrow(run, "suffix long, h long, m int, at int")


CONTEXT = "suffix long, h long, m int, doc_id long, at int, lo int, words binary, starts array<int>, stops array<int>, places array<int>, hashes binary"


def contexts(rows: DataFrame, min_words: int, window: int, size: int) -> DataFrame:
    """The shared suffixes of rows (doc_id, h, m, text, ats) with all that their windows need; ats are (at, suffix, many).

    A suffix that is not one of very many has its windows (from word ``lo`` on, one for each of ``starts``) and their words
    joined by spaces; all others of a document are one row, with the ``places`` of their windows and 16 bytes of hash for each.
    """
    kind = pa.schema([("suffix", pa.int64()), ("h", pa.int64()), ("m", pa.int32()), ("doc_id", pa.int64()), ("at", pa.int32()), ("lo", pa.int32()), ("words", pa.binary()), ("starts", pa.list_(pa.int32())), ("stops", pa.list_(pa.int32())), ("places", pa.list_(pa.int32())), ("hashes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from xxhash import xxh128_digest

        for batch in batches:
            for doc_id, h, m, text, ats in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = Words(text)
                kept = words.kept(min_words, window, size)  # rises along the text
                starts, stops = (x.astype(np.int32) for x in word_places(text))
                out, often = [], []
                for a in sorted(ats, key=lambda a: a["at"]):
                    at = a["at"]
                    lo, end = (int(x) for x in np.searchsorted(kept, [at, at + 1]))
                    if a["many"]:
                        often += range(lo, end)
                    else:
                        out.append((a["suffix"], h, m, doc_id, at, lo, b" ".join(words.words[lo : end + min_words - 1]), starts[lo:end], stops[lo + min_words - 1 : end + min_words - 1], None, None))
                if often:
                    hashes = b"".join(xxh128_digest(b" ".join(words.words[i : i + min_words])) for i in often)
                    often = np.array(often, np.int32)
                    out.append((None, h, m, doc_id, None, None, None, starts[often], stops[often + min_words - 1], often, hashes))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), kind, strict=True)], schema=kind)

    return rows.select("doc_id", "h", "m", "text", "ats").mapInArrow(run, CONTEXT)


#: Very frequent suffixes of the documents of a block, about.
BLOCK = 512

FOUND = "h long, m int, kept boolean, at int, last int, start int, stop int, first_id long"


def _matches(rows, group):
    """(place in the order of the words, common words with the row before) of rows of word numbers, within groups."""
    import numpy as np

    order = np.lexsort([*(rows[:, j] for j in range(rows.shape[1] - 1, -1, -1)), group])
    unlike = np.ones((len(rows) - 1, rows.shape[1] + 1), bool)
    unlike[:, :-1] = rows[order[1:]] != rows[order[:-1]]
    common = np.where(group[order[1:]] == group[order[:-1]], unlike.argmax(1), -1)
    place = np.empty(len(rows), np.int64)
    place[order] = np.arange(len(rows))
    return place, common


def compared(suffix, doc_id, h, m, at, lo, words, n_windows, min_words: int, window: int):
    """For suffixes in whole groups: (states, firsts), a row for each and a column for each window that ends its left
    reach there, from the leftmost on: 0 is not repeated, 1 repeated, 2 repeated and the first; firsts are rows of the first ones."""
    import numpy as np

    n, known = len(suffix), {}
    flat, sizes = [], np.zeros(n, np.int64)
    for i, row in enumerate(words):
        numbers = [known.setdefault(w, len(known) + 1) for w in row.split(b" ")]
        flat += numbers
        sizes[i] = len(numbers)
    before = at - lo
    row = np.repeat(np.arange(n), sizes)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes + before, sizes)  # 0 is the suffix's first word
    right, left = np.zeros((n, min_words), np.int32), np.zeros((n, window - 1), np.int32)
    flat, ahead = np.array(flat, np.int32), place >= 0
    right[row[ahead], place[ahead]] = flat[ahead]
    left[row[~ahead], -place[~ahead] - 1] = flat[~ahead]
    group = np.cumsum(np.r_[True, suffix[1:] != suffix[:-1]])
    on_right, common_right = _matches(right, group)
    on_left, common_left = _matches(left, group)
    class_of = lambda at_, common, reach: np.r_[0, np.cumsum(common < reach)][at_]  # noqa: E731  equal for rows that match so far
    turn = np.empty(n, np.int64)
    turn[np.lexsort((at, m, h, doc_id))] = np.arange(n)
    states, firsts = np.zeros((n, window), np.int8), np.zeros((n, window), np.int64)
    for reach in range(window):
        own = np.flatnonzero((reach <= before) & (reach > before - n_windows))
        if len(own) < 2:
            continue
        key = class_of(on_left, common_left, reach)[own] * (n + 1) + class_of(on_right, common_right, min_words - reach)[own]
        order = np.lexsort((turn[own], key))
        own, key = own[order], key[order]
        opens = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        counts = np.diff(np.r_[opens, len(key)])
        first, many = np.repeat(own[opens], counts), np.repeat(counts > 1, counts)
        states[own[many], window - 1 - reach] = np.where(first == own, 2, 1)[many]
        firsts[own[many], window - 1 - reach] = first[many]
    return states, firsts


def extended(found: DataFrame, parts: int, min_words: int, window: int, group: int = 8192) -> DataFrame:
    """FOUND rows: runs of repeated windows around each suffix, from the words on both sides of suffixes of one key."""

    def judged(t: pa.Table) -> pa.RecordBatch | None:
        import numpy as np

        suffix, h, m, doc_id, at, lo = (t.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("suffix", "h", "m", "doc_id", "at", "lo"))
        if len(suffix) < 2:
            return None
        starts, stops = (t.column(c).combine_chunks() for c in ("starts", "stops"))
        n_windows = starts.value_lengths().to_numpy()
        states, firsts = compared(suffix, doc_id, h, m, at.astype(np.int64), lo.astype(np.int64), t.column("words").to_pylist(), n_windows, min_words, window)
        edge = np.zeros((len(states), 1), np.int8)
        opens = (states > 0) & (states != np.hstack([edge, states[:, :-1]]))
        closes = (states > 0) & (states != np.hstack([states[:, 1:], edge]))
        (row, a), (_, z) = np.nonzero(opens), np.nonzero(closes)
        if not len(row):
            return None
        offset = (np.cumsum(n_windows) - n_windows)[row] - lo[row]
        a_at, z_at = at[row] - (window - 1 - a), at[row] - (window - 1 - z)
        return pa.RecordBatch.from_arrays(
            [pa.array(h[row]), pa.array(m[row]), pa.array(states[row, a] == 2), pa.array(a_at.astype(np.int32)), pa.array(z_at.astype(np.int32)), starts.flatten().take(pa.array(offset + a_at)), stops.flatten().take(pa.array(offset + z_at)), pa.array(doc_id[firsts[row, a]])],
            names=[c.split()[0] for c in FOUND.split(", ")],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if len(held) < group:
                continue
            keys = held.column("suffix").to_numpy()
            cut = int(keys.searchsorted(keys[-1]))  # the last group may go on
            if cut:
                if (out := judged(held.slice(0, cut))) is not None:
                    yield out
                held = held.slice(cut)
        if held is not None and (out := judged(held)) is not None:
            yield out

    columns = ["suffix", "h", "m", "doc_id", "at", "lo", "words", "starts", "stops"]
    return found.select(*columns).repartitionByRange(parts, "suffix").sortWithinPartitions("suffix").mapInArrow(run, FOUND)


PLACE = pa.struct([("doc_id", pa.int64()), ("h", pa.int64()), ("m", pa.int32()), ("at", pa.int32())])


def _windows(t: pa.Table):
    """(row, doc_id, h, m, at, w, x) of all windows of the documents in t, in their order; row is the document's."""
    import numpy as np

    places = t.column("places").combine_chunks()
    row = np.repeat(np.arange(len(t)), places.value_lengths().to_numpy())
    doc_id, h, m = (t.column(c).to_numpy()[row] for c in ("doc_id", "h", "m"))
    w, x = np.frombuffer(b"".join(t.column("hashes").to_pylist()), "<i8").reshape(-1, 2).T
    return row, doc_id, h, m, places.flatten().to_numpy(), w, x


def lookups(found: DataFrame) -> DataFrame:
    """(block, w, x, first) for each distinct window of each block that is repeated anywhere; first is the place of its first occurrence."""

    def run(t: pa.Table) -> pa.Table:
        import numpy as np

        _, *place, w, x = _windows(t)
        order = np.lexsort((*place[::-1], x, w))
        w, x = w[order], x[order]
        ends = np.flatnonzero(np.r_[True, (w[1:] != w[:-1]) | (x[1:] != x[:-1]), True])
        at = lambda i: pa.StructArray.from_arrays([pa.array(p[order[i]]) for p in place], fields=list(PLACE))
        own = ends[:-1]
        return pa.table({"block": t.column("block").combine_chunks().take(pa.array(np.zeros(len(own), np.int64))), "w": pa.array(w[own]), "x": pa.array(x[own]), "first": at(own), "last": at(ends[1:] - 1)})

    place = "struct<doc_id: long, h: long, m: int, at: int>"
    windows = stored(found.groupBy("block").applyInArrow(run, f"block long, w long, x long, first {place}, last {place}"), "windows")
    firsts = windows.groupBy("w", "x").agg(F.min("first").alias("first"), F.max("last").alias("last")).where("first != last").select("w", "x", "first")
    firsts = stored(firsts, "firsts")  # apart from the join, so that a window of very many blocks can be split there
    return windows.select("block", "w", "x").join(firsts, ["w", "x"])


def counted(found: DataFrame, blocks: int) -> DataFrame:
    """FOUND rows: runs of repeated windows of very frequent suffixes, by the hashes of their words; adjacent ones are one run."""
    columns = [c.split()[0] for c in FOUND.split(", ")]
    kind = pa.schema(list(zip(columns, [pa.int64(), pa.int32(), pa.bool_(), *[pa.int32()] * 4, pa.int64()], strict=True)))

    def run(t: pa.Table, known: pa.Table) -> pa.Table:
        import numpy as np

        if not len(t) or not len(known):
            return kind.empty_table()
        row, doc_id, h, m, at, w, x = _windows(t)
        number = {k: i for i, k in enumerate(zip(known.column("w").to_pylist(), known.column("x").to_pylist(), strict=True))}
        own = np.fromiter((number.get(k, -1) for k in zip(w.tolist(), x.tolist(), strict=True)), np.int64, len(w))
        first = known.column("first").combine_chunks()
        first = [first.field(c).to_numpy()[own] for c in ("doc_id", "h", "m", "at")]
        is_first = np.all([a == b for a, b in zip(first, (doc_id, h, m, at), strict=True)], axis=0)
        state = np.where(own < 0, 0, np.where(is_first, 2, 1))
        change = (row[1:] != row[:-1]) | (state[1:] != state[:-1]) | (at[1:] != at[:-1] + 1)
        a, z = np.flatnonzero(np.r_[True, change] & (state > 0)), np.flatnonzero(np.r_[change, True] & (state > 0))
        starts, stops = (t.column(c).combine_chunks().flatten() for c in ("starts", "stops"))
        return pa.Table.from_arrays([pa.array(h[a]), pa.array(m[a]), pa.array(state[a] == 2), pa.array(at[a]), pa.array(at[z]), starts.take(pa.array(a)), stops.take(pa.array(z)), pa.array(first[0][a])], schema=kind)

    block = F.pmod(F.xxhash64("doc_id", "h", "m"), F.lit(blocks)).alias("block")
    found = stored(found.select(block, "doc_id", "h", "m", "starts", "stops", "places", "hashes"), "blocks")
    return found.groupBy("block").cogroup(lookups(found).groupBy("block")).applyInArrow(run, FOUND)


def _spans(repeated: DataFrame, min_words: int) -> DataFrame:
    """Join the runs of repeated windows of each document, kept and others apart, to maximal spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            lists = batch.column(3)
            flat = lists.flatten()
            at, last, start, stop, first = (flat.field(n).to_numpy() for n in ("at", "last", "start", "stop", "first_id"))
            row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            order = np.lexsort((first, at, row))
            row, at, last, start, stop, first = (x[order] for x in (row, at, last, start, stop, first))
            opens = np.ones(len(row), bool)
            opens[1:] = (row[1:] != row[:-1]) | (at[1:] - last[:-1] > min_words)
            a = np.flatnonzero(opens)
            z = np.append(a[1:], len(row))[: len(a)] - 1
            own = [batch.column(i).take(pa.array(row[a])) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(at[a]), pa.array((last[z] + min_words - at[a]).astype(np.int32)), pa.array(start[a]), pa.array(stop[z]), pa.array(first[a])], names=["h", "m", "kept", "at", "n_words", "start", "stop", "first_id"])

    grouped = repeated.groupBy("h", "m", "kept").agg(F.collect_list(F.struct("at", "last", "start", "stop", "first_id")).alias("found"))
    return grouped.mapInArrow(run, "h long, m int, kept boolean, at int, n_words int, start int, stop int, first_id long")


def repeated_passages(docs: DataFrame, **options) -> DataFrame:
    """doc_id, start, stop (code points), n_words, kept, first_id, whole: a row for each maximal repeated span of each document.

    Kept spans are first occurrences; first_id is the document whose passage a span repeats (at its start).
    """
    return keyed_passages(docs, **options).drop("h", "m")


def keyed_passages(docs: DataFrame, min_words: int = 50, window: int = 32, size: int = 8, id_col: str = "doc_id", text_col: str = "text", most: int = 8192) -> DataFrame:
    """The rows of repeated_passages with the hashes h and m of the document's text, which tell documents of one id apart."""
    if not 1 <= size <= min_words - window + 1:
        raise ValueError("window and size do not fit min_words")
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = id_and_text(docs, id_col, text_col).withColumns({"h": F.xxhash64("text"), "m": F.hash("text")})
    ids = stored(rows.select("doc_id", "h", "m", F.length("text").alias("n_chars"), F.regexp_count("text", F.lit(WORD)).alias("n_words")).distinct(), "ids")
    least = F.min(F.coalesce("doc_id", F.lit(-(1 << 63)))).alias("first_id")
    classes = ids.groupBy("h", "m").agg(least, F.count("*").alias("copies"), F.max("n_chars").alias("n_chars"), F.max("n_words").alias("n_words"))
    classes = stored(classes, "classes")
    found = stored(suffixes(rows, min_words, window, size), "suffixes")  # range partitioning reads its input twice
    shared = stored(shared_suffixes(found, parts), "shared")
    crowds = stored(shared.groupBy("suffix").agg(F.count("*").alias("n")).where(F.col("n") > most).select("suffix", "n", F.lit(True).alias("many")), "crowds")
    marked = shared.join(crowds.drop("n"), "suffix", "left").select("h", "m", F.struct("at", "suffix", F.coalesce("many", F.lit(False)).alias("many")).alias("a"))
    chosen = marked.groupBy("h", "m").agg(F.collect_set("a").alias("ats")).join(classes.select("h", "m", F.col("first_id").alias("doc_id")), ["h", "m"])
    keyed = rows.withColumn("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))))
    held = stored(contexts(keyed.join(chosen, ["doc_id", "h", "m"]), min_words, window, size), "contexts")
    repeated = extended(held.where("words IS NOT NULL"), parts, min_words, window)
    if many := crowds.agg(F.sum("n")).head()[0]:
        repeated = repeated.unionByName(counted(held.where("words IS NULL"), max(parts, -(-many // BLOCK))))
    own = _spans(repeated, min_words).join(classes.select("h", "m", F.col("first_id").alias("doc_id")), ["h", "m"]).select("doc_id", "h", "m", "start", "stop", "n_words", "kept", "first_id")
    # Exact copies: the whole text, if long enough.
    long_enough = classes.where((F.col("copies") > 1) & (F.col("n_words") >= min_words)).select("h", "m", "first_id", F.col("n_chars").alias("stop"), "n_words")
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    copies = ids.select(key.alias("doc_id"), "h", "m").join(long_enough, ["h", "m"]).select("doc_id", "h", "m", F.lit(0).alias("start"), "stop", "n_words", (F.col("doc_id") == F.col("first_id")).alias("kept"), "first_id", F.lit(True).alias("whole"))
    own = own.withColumn("whole", F.lit(False))
    found = own.unionByName(copies)
    real = lambda c: F.when(F.col(c) != -(1 << 63), F.col(c)).alias(c)
    return found.select(real("doc_id"), "h", "m", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), F.col("n_words").cast("long").alias("n_words"), "kept", real("first_id"), "whole")


def cuts(spans: DataFrame) -> DataFrame:
    """(doc_id, h, m, cuts): what is to be cut out of each document, as sorted disjoint spans of code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        for batch in batches:
            out = []
            for found in batch.column(3).to_pylist():
                marks = [e for x in found for e in ((x["start"], x["kept"], 1), (x["stop"], x["kept"], -1))]
                depth, spans, since = {True: 0, False: 0}, [], None
                for at, kept, step in sorted(marks, key=lambda e: (e[0], -e[2])):
                    depth[kept] += step
                    inside = depth[False] > 0 and depth[True] == 0
                    if inside and since is None:
                        since = at
                    elif not inside and since is not None:
                        spans += [{"start": since, "stop": at}] * (at > since)
                        since = None
                out.append(spans)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, kind)], names=["doc_id", "h", "m", "cuts"])

    grouped = spans.where("NOT (kept AND whole)").groupBy("doc_id", "h", "m").agg(F.collect_set(F.struct("start", "stop", "kept")).alias("found"))
    return grouped.mapInArrow(run, "doc_id long, h long, m int, cuts array<struct<start: long, stop: long>>").where(F.size("cuts") > 0)


def without_repeats(docs: DataFrame, text_col: str = "text", count_col: str | None = "n_chars", **options) -> DataFrame:
    """docs with all but the first occurrence of each repeated passage cut out; documents that lose all their words go.

    Where ``count_col`` is a column it gets the new number of code points.
    """
    cut = cuts(keyed_passages(docs, text_col=text_col, **options)).toDF("i", "k", "l", "cuts")
    rows = boxed(docs, doc_id=F.col(options.get("id_col", "doc_id")).cast("long"), text=text_of(text_col))
    rows = rows.withColumns({"h": F.xxhash64("text"), "m": F.hash("text")})
    joined = rows.join(cut, rows["doc_id"].eqNullSafe(cut["i"]) & (rows["h"] == cut["k"]) & (rows["m"] == cut["l"]), "left")
    left = F.expr("aggregate(cuts, named_struct('p', 0L, 'o', ''), (a, x) -> named_struct('p', x.stop, 'o', concat(a.o, substring(text, cast(a.p + 1 as int), cast(x.start - a.p as int)))), a -> concat(a.o, substring(text, cast(a.p + 1 as int))))")
    edited = joined.withColumn("left", F.when(F.col("cuts").isNotNull(), left)).where(F.col("cuts").isNull() | F.col("left").rlike(r"[^\x20\x09-\x0D]"))
    own = F.col("row").getField
    changed = {text_col: F.coalesce("left", own(text_col))}
    if count_col in docs.columns:
        changed[count_col] = F.when(F.col("cuts").isNotNull(), F.length("left").cast(docs.schema[count_col].dataType)).otherwise(own(count_col))
    return edited.select(*(changed.get(c, own(c)).alias(c) for c in docs.columns))


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(documents(spark, sf_dir))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without repeats of passages of 50 words or more; see without_repeats."""
    return without_repeats(docs)


QUERIES = {"op1_suffix_dedup": op1_suffix_dedup}
SQL: dict[str, str] = {}
