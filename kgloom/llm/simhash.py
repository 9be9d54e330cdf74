"""Operator 2: SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has 64 bits. For radius r every bit position gets a non-zero vector of r + 1 bits, and table v (each
non-zero vector, 2^(r+1) - 1 in all) keeps the positions whose vector has odd product with v. Up to r differing
positions span at most r dimensions, so some v is orthogonal to all of them: that table drops every differing bit and
the pair collides there. No pair within the radius is missed.

Work is done on distinct fingerprints (exact copies collapse first). A bucket of up to ``most`` fingerprints is compared
in memory, block by block, and yields a star of links for each connected part, never its pairs. Larger buckets take
another exact way: fingerprints at distance 2 or less share a word at distance 1 or less from both, so each member names
its 65 such words and members meet at the words. Groups are the connected components of all links.

The pipeline's stage takes five-word shingles and Jaccard similarity 0.8 (``one_of_similar``). No family of covering masks
reaches that far (such pairs differ in some 15 % of their bits), so wide prints of several fingerprints are cut into
samples of bits, each anchored at a least shingle hash, so that buckets hold texts that share text whatever the size of the
corpus. Candidates are then compared on their shingles. Where a bucket has too many of them, a tree of near ones comes first,
and then all pairs of its texts that are still in different groups (``across``), so that no link of a bucket is lost.

Nulls and edge cases: a null text is empty; a text without words has fingerprint zero, linked like any other; a null
doc_id takes part but never names a component unless its group has no other id. Repeated rows are returned each. An
empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.llm.common import boxed, checkpoint, documents, id_and_text, let_go, map_rows, stored, text_of
from kgloom.llm.suffix_dedup import mixed
from kgloom.operators.components import connected_components

BITS = 64
#: Wide prints of whole stages: bits, tables, bits of a sample, greatest distance, and the shingles of a short text.
WIDE, TABLES, TAKEN, RADIUS, FEW = 256, 32, 8, 80, 40


def fingerprint(text: str, width: int = 3) -> int:
    """Unsigned SimHash of a text: majority bits over the XXH64 (seed 42) of its word shingles."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else [b" ".join(words)]
    hashes = np.fromiter((xxh64_intdigest(s, 42) for s in shingles), np.uint64)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 65536):
        block = hashes[at : at + 65536]
        ones += np.unpackbits(block.view(np.uint8).reshape(len(block), 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def make():
        def each(columns: list[list]) -> list:
            ids, texts = columns
            found = [fingerprint(t, width) for t in texts]
            return [ids, [x - (1 << BITS) if x >> (BITS - 1) else x for x in found]]

        return each

    return map_rows(id_and_text(docs, id_col, text_col), "doc_id long, fp long", pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())]), make)


def masks(radius: int) -> list[int]:
    """Signed 64-bit masks of the covering tables."""
    n = 1 << (radius + 1)
    found = [sum(1 << i for i in range(BITS) if (v & (1 + i % (n - 1))).bit_count() % 2) for v in range(1, n)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in found]


def _stars(members: list[int], radius: int) -> list[tuple[int, int]]:
    """Links that connect just what pairs within the radius connect, in O(n) memory a block."""
    import numpy as np

    x = np.array(members, np.int64).view(np.uint64)
    out, left = [], np.ones(len(x), bool)
    for start in range(len(x)):
        if not left[start]:
            continue
        left[start] = False
        todo = [start]
        while todo:
            i = todo.pop()
            rest = np.flatnonzero(left)
            near = rest[np.bitwise_count(x[rest] ^ x[i]) <= radius]
            left[near] = False
            todo += near.tolist()
            out += [(members[start], members[j]) for j in near.tolist()]
    return out


def links(distinct: DataFrame, radius: int = 2, most: int = 4096) -> DataFrame:
    """(u, v): links over a table of distinct fingerprints fp whose components are those of all pairs within the radius.

    For radius 2 or less; buckets beyond ``most`` go through the words between their members, which are linked too.
    """
    if not 0 <= radius <= 2:
        raise ValueError("the radius is 0, 1 or 2")
    kept = F.array(*(F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(masks(radius))))
    rows = distinct.select("fp", F.explode(kept).alias("b")).select("fp", "b.t", "b.k")
    sizes = rows.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1")
    held = checkpoint(rows.join(sizes, ["t", "k"]))
    small = held.where(F.col("n") <= most).groupBy("t", "k").agg(F.collect_list("fp").alias("fps")).select("fps")

    def make():
        def each(columns: list[list]) -> list:
            pairs = [p for fps in columns[0] for p in _stars(fps, radius)]
            return [[p[0] for p in pairs], [p[1] for p in pairs]]

        return each

    found = map_rows(small, "u long, v long", pa.schema([("u", pa.int64()), ("v", pa.int64())]), make)
    steps = [0, *((1 << i) - (1 << BITS) * (i == BITS - 1) for i in range(BITS))] if radius else [0]
    rays = held.where(F.col("n") > most).select("fp").distinct().select("fp", F.explode(F.array(*(F.col("fp").bitwiseXOR(F.lit(s)) for s in steps))).alias("w"))
    if radius == 1:  # a member and the word of another: only words that are members count
        rays = rays.join(distinct.select(F.col("fp").alias("w")), "w", "left_semi")
    hubs = rays.groupBy("w").agg(F.min("fp").alias("hub"), F.count("*").alias("n")).where("n > 1").select("w", "hub")
    return found.unionByName(rays.join(hubs, "w").where("fp != hub").select(F.col("fp").alias("u"), F.col("hub").alias("v"))).distinct()


def near_duplicates(docs: DataFrame, radius: int = 2, most: int = 4096, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """doc_id, fingerprint (hex), component_id (least doc_id of the group) for every row of docs."""
    each = checkpoint(fingerprints(docs, id_col, text_col, width))
    distinct = checkpoint(each.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = connected_components(links(distinct.select("fp"), radius, most), "u", "v", checkpoint)
    grouped = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    named = grouped.join(least, "root").select("fp", "component_id")
    return each.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def text_key(text_col: str) -> Column:
    """The key of a text: equal texts have equal keys."""
    return F.xxhash64(text_of(text_col))


def one_row_each(docs: DataFrame, roots: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each group of texts; all columns stay. roots: (h, root) for texts that are in a group with others.

    A row is known by its id and text. The least id is kept, null ids last; rows without id count by their texts. Of rows
    that repeat both id and text any one stays.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(text_col).alias("h")).groupBy("doc_id", "h").agg(F.count("*").alias("n"))
    named = rows.join(roots, "h", "left").withColumn("root", F.coalesce("root", "h"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h", "n")
    kept = stored(named.groupBy("root").agg(F.min(place).alias("best")).select(F.col("best.doc_id").alias("i"), F.col("best.h").alias("k"), F.col("best.n").alias("n")), "kept")
    held = boxed(docs, doc_id=F.col(id_col).cast("long"), h=text_key(text_col))
    match = lambda some: held["doc_id"].eqNullSafe(some["i"]) & (held["h"] == some["k"])
    single, repeated = kept.where("n = 1"), kept.where("n > 1")
    found = held.join(single, match(single), "left_semi").select("row.*")
    if repeated.isEmpty():  # as a rule: then texts are shuffled once
        return found
    return found.unionByName(held.join(repeated, match(repeated), "left_semi").dropDuplicates(["doc_id", "h"]).select("row.*"))


def one_of_each(docs: DataFrame, radius: int = 2, most: int = 4096, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """One row of docs for each group of near_duplicates; all columns stay."""
    texts = docs.select(text_key(text_col).alias("h"), F.col(text_col).alias("text"))
    prints = checkpoint(fingerprints(texts, "h", "text", width).select(F.col("doc_id").alias("h"), "fp").distinct())
    linked = connected_components(links(prints.select("fp").distinct(), radius, most), "u", "v", checkpoint)
    roots = prints.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select("h", F.coalesce("root", "fp").alias("root"))
    return one_row_each(docs, roots, id_col, text_col)


def shingle_hashes(text: str, width: int = 5):
    """The sorted distinct XXH64 (seed 42) of the word shingles of a text, as unsigned 64-bit numbers."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else [b" ".join(words)]
    return np.unique(np.fromiter((xxh64_intdigest(s, 42) for s in shingles), np.uint64))


def wide_bits(hashes):
    """The WIDE bits of the SimHash of distinct shingle hashes, as 0 and 1."""
    import numpy as np

    ones = np.zeros(WIDE, np.int64)
    for at in range(0, len(hashes), 16384):
        block = hashes[at : at + 16384]
        prints = np.stack([mixed(block + np.uint64(i * 0x9E3779B97F4A7C15 % (1 << 64))) for i in range(WIDE // BITS)], axis=1)
        ones += np.unpackbits(prints.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return (2 * ones > len(hashes)).astype(np.uint8)


def least_of_bins(hashes):
    """The least hash in each of TABLES ranges of hashes (sorted, distinct); an empty range takes that of another one, tried
    in an order of its own. Two sets agree in a range with the probability of their Jaccard similarity."""
    import numpy as np

    edges = np.append(np.searchsorted(hashes, np.arange(TABLES, dtype=np.uint64) * np.uint64((1 << 64) // TABLES)), len(hashes))
    tries = np.stack([np.r_[t, np.random.default_rng(t).permutation(TABLES)] for t in range(TABLES)])
    taken = tries[np.arange(TABLES), (edges[1:] > edges[:-1])[tries].argmax(1)]
    return hashes[edges[taken]]


def sketches(rows: DataFrame, width: int, threshold: float) -> DataFrame:
    """(h, f, keys, least) of rows (h, text): the print as four longs, the keys of TABLES buckets in which the text is
    compared, and for short texts the shingles they also meet at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        let_go()
        places = np.stack([np.random.default_rng(t).choice(WIDE, TAKEN, replace=False) for t in range(TABLES)])
        powers, tables, had = 1 << np.arange(TAKEN), np.arange(TABLES) << TAKEN, set()
        longs = pa.list_(pa.int64())
        for batch in batches:
            out = []
            for h, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if h in had:  # an exact copy
                    continue
                if len(had) > 500_000:
                    had.clear()
                had.add(h)
                found = shingle_hashes(text, width)
                bits = wide_bits(found)
                sample, least = bits[places] @ powers, least_of_bins(found)
                keys = mixed(least ^ mixed((sample + tables + 1).astype(np.uint64)))
                # two sets within the threshold share one of so many least hashes
                short = found[: len(found) - math.ceil(threshold * len(found)) + 1] if len(found) <= FEW else found[:0]
                out.append((h, np.packbits(bits, bitorder="little").view(np.int64), keys.view(np.int64), short.view(np.int64)))
            if out:
                h, *arrays = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), *(pa.array(x, longs) for x in arrays)], names=["h", "f", "keys", "least"])

    return rows.select("h", "text").mapInArrow(run, "h long, f array<long>, keys array<long>, least array<long>")


def distances(x, y):
    """How many bits differ between each print of x and each of y (rows of unsigned 64-bit numbers)."""
    import numpy as np

    a, b = (2 * np.unpackbits(p.view(np.uint8), axis=1).astype(np.float32) - 1 for p in (x, y))
    return ((WIDE - a @ b.T) / 2).astype(np.int16)


def near_pairs(h, x, radius: int, partial=None):
    """Rows (u, v, distance): pairs of h whose prints (rows of x) differ in up to radius bits: all of them, or where they are
    many those of a tree of least distances. Then partial() is called, since the other pairs are still to be compared."""
    import numpy as np

    n, d = len(x), distances(x, x)
    i, j = np.nonzero(d <= radius)
    i, j = i[i < j], j[i < j]
    if len(i) <= 16 * n + 64:
        return np.stack([np.minimum(h[i], h[j]), np.maximum(h[i], h[j]), d[i, j]], axis=1)
    if partial:
        partial()
    best, source, out = d[0].copy(), np.zeros(n, np.int64), np.empty((n - 1, 2), np.int64)
    best[0] = WIDE + 1
    taken = np.zeros(n, bool)
    taken[0] = True
    for k in range(n - 1):
        at = int(best.argmin())
        out[k] = source[at], at
        taken[at] = True
        nearer = (d[at] < best) & ~taken
        best[nearer], source[nearer] = d[at][nearer], at
        best[at] = WIDE + 1
    i, j = out.T
    kept = d[i, j] <= radius
    return np.stack([np.minimum(h[i], h[j]), np.maximum(h[i], h[j]), d[i, j]], axis=1)[kept]


PRINT = tuple(f"f{i}" for i in range(WIDE // BITS))


def bucket_pairs(each: DataFrame) -> DataFrame:
    """(u, v, d, key): the near_pairs of each bucket (key, part) of rows (key, part, h, f0, ...), with their distances; a
    bucket whose pairs are not all there has a row of its key alone."""
    kind = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("d", pa.int32()), ("key", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        held, size, partial = [], 0, []

        def flush() -> pa.RecordBatch:
            u, v, d = np.unique(np.concatenate(held), axis=0).T if held else np.empty((3, 0), np.int64)
            none, keys = [None] * len(partial), [None] * len(u) + partial
            columns = [pa.concat_arrays([pa.array(x.astype(t)), pa.array(none, pa.from_numpy_dtype(t))]) for x, t in ((u, np.int64), (v, np.int64), (d, np.int32))]
            held.clear()
            partial.clear()
            return pa.RecordBatch.from_arrays([*columns, pa.array(keys, pa.int64())], schema=kind)

        for batch in batches:
            for key, bucket in zip(*batch.columns, strict=True):
                flat = bucket.values
                h, first = np.unique(flat.field("h").to_numpy(), return_index=True)
                if len(h) > 1:
                    found = near_pairs(h, np.stack([flat.field(f).to_numpy() for f in PRINT], axis=1)[first].view(np.uint64), RADIUS, lambda key=key: partial.append(key.as_py()))
                    held.append(found)
                    size += len(found)
                if size > 100_000:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    buckets = each.groupBy("key", "part").agg(F.collect_list(F.struct("h", *PRINT)).alias("held")).where(F.size("held") > 1).select("key", "held")
    return buckets.mapInArrow(run, "u long, v long, d int, key long")


def overfull(each: DataFrame, most: int) -> DataFrame:
    """(key, n) of the buckets of over ``most`` rows, as a table whose size is known when it is joined."""
    return stored(each.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > most), "overfull")


def bucketed(found: DataFrame, *more: str) -> DataFrame:
    """(key, t, h, f0, ..., more) of sketches: each text in its buckets, those of short texts behind those of the tables."""
    own = ["h", *(F.col("f")[i].alias(f) for i, f in enumerate(PRINT)), *more]
    short = found.select(F.explode("least").alias("key"), F.lit(TABLES).alias("t"), *own)
    return found.select(F.posexplode("keys").alias("t", "key"), *own).select(short.columns).unionByName(short)


def candidates(rows: DataFrame, width: int, threshold: float, most: int = 2048) -> DataFrame:
    """(u, v, d, key): pairs of texts (keys h) to be compared, and how many bits of their prints differ; rows of a key alone are
    the buckets whose pairs are not all there. rows: (h, text), or sketches of them.

    A bucket of over ``most`` texts is compared in parts of about that many, each together with four texts that are the same
    for all parts of the bucket, so that a group of texts that are all alike is connected and no task holds an unbounded group.
    Its pairs across parts are not there, so it has such a row too. ``across`` compares what is left.
    """
    found = rows if "keys" in rows.columns else stored(sketches(rows, width, threshold), "sketches")
    keyed = bucketed(found)
    full = overfull(keyed, most)
    pairs = bucket_pairs(keyed.join(full, "key", "left_anti").select("key", F.lit(0).alias("part"), "h", *PRINT))
    if full.isEmpty():
        return pairs.distinct()
    crowd = keyed.join(full, "key").withColumn("parts", F.ceil(F.col("n") / most).cast("int"))
    hubs = crowd.groupBy("key", "parts").agg(*(F.min(F.struct(F.xxhash64("h", F.lit(i)).alias("r"), "h", *PRINT)).alias(f"b{i}") for i in range(4)))
    hubs = hubs.select("key", "parts", F.explode(F.array(*(f"b{i}" for i in range(4)))).alias("b"))
    hubs = hubs.select("key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "b.h", *(F.col(f"b.{f}").alias(f) for f in PRINT))
    dealt = crowd.select("key", F.pmod(F.xxhash64("h", F.lit(9)), F.col("parts")).cast("int").alias("part"), "h", *PRINT)
    none = F.lit(None).cast("long")
    return pairs.unionByName(bucket_pairs(dealt.unionByName(hubs))).unionByName(full.select(none.alias("u"), none.alias("v"), none.cast("int").alias("d"), "key")).distinct()


def in_blocks(members: DataFrame, most: int) -> DataFrame:
    """Rows of members (key, n, s, h, small, ...), n of a key and s of them small, dealt to blocks (key, p, q): every member of part p, and as ``asks`` the small ones of
    part q, so that in one of the blocks each small member meets each member, and no block holds many more than 2 ``most`` rows."""
    share = lambda c: F.ceil(F.col(c) / most).cast("int")
    part = lambda seed, c: F.pmod(F.xxhash64("h", F.lit(seed)), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    rows = members.withColumns({"ps": share("n"), "qs": share("s")})
    own = [c for c in members.columns if c not in ("key", "n", "s")]
    told = rows.select("key", part(7, "ps").alias("p"), every("qs").alias("q"), F.lit(False).alias("asks"), *own)
    asked = rows.where("small").select("key", every("ps").alias("p"), part(8, "qs").alias("q"), F.lit(True).alias("asks"), *own)
    return told.unionByName(asked).groupBy("key", "p", "q").agg(F.collect_list(F.struct("asks", *own)).alias("held")).select("key", "held")


def _block(bucket):
    """(fields, asks, others): the fields of a block as arrays by name, and the rows of those that ask and of all members."""
    import numpy as np

    flat = bucket.values
    fields = {f.name: flat.field(f.name).to_numpy(zero_copy_only=False) for f in flat.type if f.name != "asks"}
    asks = flat.field("asks").to_numpy(zero_copy_only=False)
    return fields, np.flatnonzero(asks), np.flatnonzero(~asks)


def across(found: DataFrame, partial: DataFrame, roots: DataFrame, sets_of, threshold: float, most: int = 2048) -> DataFrame | None:
    """(u, v): links that join all pairs of texts in one bucket that are similar and not in one group yet, or None if each
    bucket is within one group. found: sketches; partial: the keys of the buckets; roots: (node, root) of what is linked so
    far; sets_of(hs): (h, shingles) of texts.

    In each bucket the members outside its largest group (the small ones) are compared with all others, in blocks of bounded
    size. The prints tell first which texts have a candidate (a pair counts in the first of the tables where it meets); only
    those travel with their shingles, and their block links them there, so that pairs are never rows.
    """
    rooted = found.join(roots.select(F.col("node").alias("h"), "root"), "h", "left").withColumn("root", F.coalesce("root", "h"))
    groups = bucketed(rooted, "root").join(partial, "key", "left_semi").groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("n"))
    open_ = stored(groups.where("top.n < n").select("key", "n", (F.col("n") - F.col("top.n")).alias("s"), F.col("top.root").alias("top")), "open")
    if open_.isEmpty():
        return None
    named = bucketed(rooted, "root", "keys").join(open_, "key")
    blocks = in_blocks(named.select("key", "n", "s", "t", "h", "root", (F.col("root") != F.col("top")).alias("small"), *PRINT, "keys"), most)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for key, bucket in zip(*batch.columns, strict=True):
                x, asks, told = _block(bucket)
                prints, t = np.stack([x[f] for f in PRINT], axis=1).view(np.uint64), int(x["t"][0])
                keys, used = np.stack(x["keys"])[:, :t], np.zeros(len(x["h"]), bool)
                near = distances(prints[asks], prints[told]) <= RADIUS
                near &= x["root"][asks, None] != x["root"][told]
                near &= ~x["small"][told] | (x["h"][told] > x["h"][asks, None])  # of two small ones either asks
                for i, row in zip(asks.tolist(), near, strict=True):
                    j = told[row]
                    j = j[~(keys[j] == keys[i]).any(1)]
                    used[j] = True
                    used[i] |= len(j) > 0
                if used.any():
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(used.sum(), key.as_py())), *(pa.array(x[c][used]) for c in ("h", "root", "small"))], names=["key", "h", "root", "small"])

    left = stored(blocks.mapInArrow(meet, "key long, h long, root long, small boolean").distinct(), "left")
    if left.isEmpty():
        return None
    sizes = left.groupBy("key").agg(F.count("*").alias("n"), F.count(F.when(F.col("small"), 1)).alias("s"))
    blocks = in_blocks(left.join(sizes, "key").join(stored(sets_of(left.select("h").distinct()), "sets"), "h"), most)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            out = []
            for bucket in batch.column(1):
                x, asks, told = _block(bucket)
                h, small, group = x["h"], x["small"], np.unique(x["root"], return_inverse=True)[1]
                sizes = np.array([len(s) for s in x["shingles"]])
                values, flat = np.unique(np.concatenate(x["shingles"]), return_inverse=True)
                sets, has = np.split(flat, np.cumsum(sizes)[:-1]), np.zeros(len(values), bool)
                for i in asks.tolist():
                    j = told[(group[told] != group[i]) & (~small[told] | (h[told] > h[i])) & (np.minimum(sizes[told], sizes[i]) >= threshold * np.maximum(sizes[told], sizes[i]) - 1)]
                    if not len(j):
                        continue
                    has[sets[i]] = True
                    both = np.add.reduceat(has[np.concatenate([sets[k] for k in j])], np.cumsum(sizes[j]) - sizes[j], dtype=np.int64)
                    has[sets[i]] = False
                    j = j[both / (sizes[i] + sizes[j] - both) >= threshold]
                    joined, first = np.unique(group[j], return_index=True)
                    out += [(h[i], h[k]) for k in j[first]]
                    group[np.isin(group, joined)] = group[i]
            if out:
                u, v = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return stored(blocks.mapInArrow(link, "u long, v long").distinct(), "across")


def shingle_sets(rows: DataFrame, width: int) -> DataFrame:
    """(h, shingles) of rows (h, text)."""

    def make():
        import numpy as np

        return lambda columns: [columns[0], [shingle_hashes(t, width).view(np.int64) for t in columns[1]]]

    return map_rows(rows.select("h", "text"), "h long, shingles array<long>", pa.schema([("h", pa.int64()), ("shingles", pa.list_(pa.int64()))]), make)


def similar(docs: DataFrame, threshold: float = 0.8, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(h, root): texts (by text_key) that pairs of this Jaccard similarity of word shingles connect, and one text of each group.

    Candidates agree in one of TABLES buckets, each of a least shingle hash and TAKEN bits of the wide SimHash print, and
    differ in up to RADIUS bits: a pair just at 0.8 does so with probability 0.999. Texts of up to FEW shingles
    also meet at shingles, where no pair is missed. All candidates are checked on their shingles, but those of texts that
    are in one group already.
    """
    rows = id_and_text(docs, id_col, text_col).select(F.xxhash64("text").alias("h"), "text")
    held = stored(sketches(rows, width, threshold), "sketches")
    found = stored(candidates(held, width, threshold), "pairs")
    pairs, partial = found.where("u IS NOT NULL").select("u", "v", "d"), stored(found.where("u IS NULL").select("key").distinct(), "partial")
    # copies go in their tasks, before any shuffle
    sets_of = lambda some: shingle_sets(rows.dropDuplicates(["h"]).join(some, "h", "left_semi"), width)
    needed = stored(pairs.select("u").union(pairs.select("v")).distinct().toDF("h"), "needed")
    sets = stored(sets_of(needed), "sets")
    of = lambda c: sets.select(F.col("h").alias(c), F.col("shingles").alias(f"s{c}"))

    def alike(some: DataFrame) -> DataFrame:
        both = F.size(F.array_intersect("su", "sv"))
        return some.join(of("u"), "u").join(of("v"), "v").where(both / (F.size("su") + F.size("sv") - both) >= threshold).select("u", "v")

    # The nearest candidate of each text first; then all candidates whose texts are not in one group by that.
    way = lambda a, b: pairs.select(F.col(a).alias("a"), F.struct("d", F.col(b).alias("b")).alias("x"))
    nearest = way("u", "v").unionByName(way("v", "u")).groupBy("a").agg(F.min("x").alias("x")).select(F.least("a", "x.b").alias("u"), F.greatest("a", "x.b").alias("v")).distinct()
    linked = stored(alike(nearest), "alike")
    roots = connected_components(linked, "u", "v", checkpoint)
    root = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
    apart = pairs.select("u", "v").distinct().join(root("u"), "u", "left").join(root("v"), "v", "left").where(F.coalesce("ru", "u") != F.coalesce("rv", "v"))
    rest = stored(alike(apart.select("u", "v").join(nearest, ["u", "v"], "left_anti")), "alike")
    if not rest.isEmpty():
        linked = linked.unionByName(rest)
        roots = connected_components(linked, "u", "v", checkpoint)
    if not partial.isEmpty():
        more = across(held, partial, roots, sets_of, threshold)
        if more is not None:
            roots = connected_components(linked.unionByName(more), "u", "v", checkpoint)
    return roots.withColumnRenamed("node", "h")


def one_of_similar(docs: DataFrame, threshold: float = 0.8, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each group of similar texts; all columns stay."""
    return one_row_each(docs, similar(docs, threshold, width, id_col, text_col), id_col, text_col)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8); see one_row_each for ids and repeats."""
    return one_of_similar(docs)


QUERIES = {"op2_simhash": op2_simhash}
SQL: dict[str, str] = {}
