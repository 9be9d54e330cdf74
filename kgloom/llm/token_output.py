"""Operator 6: token ids in binary shards with minimal perfect hash indexes.

A shard file holds, in ascending doc_id order, the ids of its documents as raw little-endian unsigned 16- or 32-bit numbers,
and an index that maps a document key to its place among them. The index is a minimal perfect hash: level by level, keys
that have a bit of their own take it, the others go to the next level; the rank of a key's bit is its slot. A slot
stores a 32-bit fingerprint of its key (a key that is not in the shard is found out with probability 1 - 2^-32), the
offset and the length. So one access costs a few hash steps and one read, however many documents there are: an opened
shard holds its index and reads the slice of each document that is asked for.

Documents are encoded where they are read, travel once as compressed ids to the range of their doc_id and text hash, and are
written by the task that sorts the range. A shard's name is its own, and the manifest (a Parquet table, a row for each
shard, with the number of ids before it) names the shards of the tasks that succeeded, so a task that runs again after a
lost executor leaves no wrong files in use.

A document's key is its doc_id and the number of equal doc_ids before it, so repeated ids keep a place each (ties ordered
by text hash, then ids); those of an id that fills several ranges are counted on from shard to shard. Null doc_ids come first. A null text is encoded as an empty one: just the end id. An empty table gives an
empty manifest. Texts of any length are encoded whole; a shard is closed beyond ``shard_ids`` ids.
"""

from __future__ import annotations

import json
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgloom.llm.common import NULL_ID, Ranges, documents, id_and_text, id_array, kept, shared_dir

MAGIC = b"KGIDS\x00\x00\x01"


class Generations:
    """A bounded map: beyond ``most`` entries all become the old generation, from which those in use are taken over."""

    def __init__(self, most: int):
        self.most, self.now, self.old = most, {}, {}

    def missing(self, keys: set) -> set:
        if len(self.now) > self.most:
            self.now, self.old = {}, self.now
        now, old = self.now, self.old
        left = keys.difference(now)
        if not old:
            return left
        new = left.difference(old)
        again = left - new
        now.update(zip(again, map(old.__getitem__, again), strict=True))
        return new


class WordEncoder:
    """A tokenizers file of the kind lower case, words by pattern, BPE with word ends: words are encoded once and cached.

    ``encode_all`` gives the bytes of the ids of each text. New words of a group of texts go to the library together, already
    split; the ids that end a word part them again. Texts that this could treat differently (special strings, a capital
    sigma, unusual white space) go to the library whole.
    """

    def __init__(self, path: str, most: int = 300_000):
        import numpy as np
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        with open(path) as f:
            spec = json.load(f)
        size = self.tokenizer.get_vocab_size()
        self.kind = "<u2" if size <= 1 << 16 else "<u4"
        steps = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        split = [p for p in (spec.get("pre_tokenizer") or {}).get("pretokenizers", []) if p["type"] == "Split"]
        end = spec["model"].get("end_of_word_suffix")
        self.quick = bool(end) and steps == ["NFC", "Replace", "Lowercase"] and len(split) == 1 and split[0]["behavior"] == "Removed" and split[0]["invert"]
        self.find = regex.compile(split[0]["pattern"]["Regex"] if self.quick else r"\S+").findall
        self.letters = all(self.find(f"aé中ж{x}") == ["aé中ж", x] for x in ".,;:!?")  # letters are one word, a mark behind them another
        self.odd = ["Σ", "\x0b", "\x0c", *map(chr, range(28, 32)), "\x85", "\u200b", "\u180e", *(t["content"] for t in spec["added_tokens"])]
        self.common = regex.compile("[!-~¡-ɏЀ-ӿ‐-‧一-龥]*").fullmatch
        self.plain = Tokenizer(self.tokenizer.model)  # for words that are split and normalised already
        self.plain.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        if hasattr(self.plain.model, "_resize_cache"):
            self.plain.model._resize_cache(0)  # no word comes twice
        self.ends = np.array([str(self.tokenizer.id_to_token(i)).endswith(end or "\0") for i in range(size)])
        self.words, self.chunks = Generations(most), Generations(most * 3 // 2)

    def _library(self, text: str) -> bytes:
        import numpy as np

        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _learn(self, chunks: set[str]) -> None:
        """Encode the chunks (texts between white space, as they stand) that are not known."""
        import numpy as np

        single, parts = {}, {}  # chunks of one word, and of several
        for c in self.chunks.missing(chunks):
            if c.isascii():
                w = c.lower()
            elif self.common(c):
                w = unicodedata.normalize("NFC", c).lower()
            else:  # the library's character data may be of another Unicode version
                self.chunks.now[c] = self._library(c)
                continue
            if self.letters and w.isalpha():
                single[c] = w
                continue
            if self.letters and w[-1] in ".,;:!?" and w[:-1].isalpha():
                parts[c] = [w[:-1], w[-1]]
                continue
            ws = self.find(w)
            if len(ws) == 1:
                single[c] = ws[0]
            else:
                parts[c] = ws
        new = list(self.words.missing(set(single.values()).union(*parts.values())))
        if new:
            ids = np.array(self.plain.encode_batch_fast([new], is_pretokenized=True, add_special_tokens=False)[0].ids, self.kind)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(new):
                data, ends = ids.tobytes(), (stops * int(self.kind[2:])).tolist()
                self.words.now.update(zip(new, map(data.__getitem__, map(slice, [0, *ends[:-1]], ends)), strict=True))
            else:
                self.words.now.update((w, self._library(w)) for w in new)
        known = self.words.now.__getitem__
        self.chunks.now.update(zip(single, map(known, single.values()), strict=True))
        self.chunks.now.update((c, b"".join(map(known, ws))) for c, ws in parts.items())

    def encode_all(self, texts: list[str], group: int = 512) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(texts), group):
            some = [None if not self.quick or any(x in t for x in self.odd) else t.split() for t in texts[at : at + group]]
            self._learn(set().union(*(x for x in some if x)))
            known = self.chunks.now.__getitem__
            out += [self._library(t) if x is None else b"".join(map(known, x)) for t, x in zip(texts[at : at + group], some, strict=True)]
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


def word_encoder(path: str) -> WordEncoder:
    """One for all tasks of a worker, with its caches."""
    return kept(("words", path), lambda: WordEncoder(path))


def mix(x, seed: int):
    """64-bit hash of an array of unsigned 64-bit keys."""
    import numpy as np

    z = x + np.uint64((seed * 0x9E3779B97F4A7C15) & (1 << 64) - 1)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def keys_of(ids, repeats):
    """Unsigned keys of (doc_id, number of equal ids before)."""
    import numpy as np

    k = np.asarray(ids, np.int64).view(np.uint64)
    r = np.asarray(repeats, np.uint64)
    return np.where(r == 0, k, mix(k ^ mix(r, 11), 12))


class PerfectHash:
    """Minimal perfect hash over distinct unsigned 64-bit keys: slots 0 to n - 1."""

    def __init__(self, levels: list):
        import numpy as np

        self.levels, self.ranks, before = levels, [], 0
        for bits in levels:
            ones = np.bitwise_count(bits).astype(np.int64)
            self.ranks.append(before + np.cumsum(ones) - ones)
            before += int(ones.sum())

    @classmethod
    def build(cls, keys, room: float = 1.7) -> PerfectHash:
        import numpy as np

        levels, left = [], keys
        while len(left):
            if len(levels) > 200:
                raise ValueError("keys repeat")
            n = 64 * max(1, int(-(-room * len(left) // 64)))
            at = mix(left, 2 * len(levels) + 1) % np.uint64(n)
            times = np.bincount(at.astype(np.int64), minlength=n)
            levels.append(np.packbits(times == 1, bitorder="little").view(np.uint64))
            left = left[times[at.astype(np.int64)] != 1]
        return cls(levels)

    def slots(self, keys):
        """The slot of each key; for a key that was not built in, any slot or -1."""
        import numpy as np

        out = np.full(len(keys), -1, np.int64)
        for i, bits in enumerate(self.levels):
            todo = np.flatnonzero(out < 0)
            if not len(todo):
                break
            at = mix(keys[todo], 2 * i + 1) % np.uint64(64 * len(bits))
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            own = (bits[word] >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(bits[word] & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[todo[own]] = (self.ranks[i][word] + below)[own]
        return out


def shard_bytes(ids: list[int], repeats: list[int], payloads: list[bytes], kind: str) -> list[bytes]:
    """The parts of a shard file: header, index, payload."""
    import numpy as np

    keys, width = keys_of(ids, repeats), int(kind[2:])
    lengths = np.array([len(p) // width for p in payloads], np.int64)
    index = PerfectHash.build(keys)
    at, n = index.slots(keys), len(keys)
    prints, offsets, sizes = np.zeros(n, "<u4"), np.zeros(n, "<i8"), np.zeros(n, "<i8")
    prints[at], offsets[at], sizes[at] = (mix(keys, 99) >> np.uint64(32)).astype("<u4"), np.cumsum(lengths) - lengths, lengths
    head = struct.pack("<8sIIQQ", MAGIC, width, len(index.levels), n, int(lengths.sum())) + struct.pack(f"<{len(index.levels)}Q", *map(len, index.levels))
    return [head, *(x.tobytes() for x in index.levels), offsets.tobytes(), sizes.tobytes(), prints.tobytes(), *payloads]


class Shard:
    """Keyed access to the documents of one shard; ``read(offset, size)`` gives bytes of its file.

    The index is held; payloads are read when asked for. ``before`` is the number of rows with the shard's first id in earlier shards.
    """

    def __init__(self, read, before: int = 0):
        import numpy as np

        magic, self.width, levels, n, self.n_ids = struct.unpack("<8sIIQQ", read(0, 32))
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        words = struct.unpack(f"<{levels}Q", read(32, 8 * levels))
        kinds = [*(("<u8", w) for w in words), ("<i8", n), ("<i8", n), ("<u4", n)]
        size = sum(m * int(kind[2:]) for kind, m in kinds)
        data, at, parts = read(32 + 8 * levels, size), 0, []
        for kind, m in kinds:
            parts.append(np.frombuffer(data, kind, m, at))
            at += m * int(kind[2:])
        self.index, (self.offsets, self.sizes, self.prints) = PerfectHash(parts[:-3]), parts[-3:]
        self.read, self.payload, self.before = read, 32 + 8 * levels + size, before

    def places(self, ids, repeats):
        """(offset, length) arrays, in ids; -1 for keys that the shard does not hold."""
        import numpy as np

        keys = keys_of(ids, repeats)
        at = self.index.slots(keys)
        ok = at >= 0
        ok[ok] = self.prints[at[ok]] == (mix(keys[ok], 99) >> np.uint64(32)).astype(np.uint32)
        return np.where(ok, self.offsets[at], -1), np.where(ok, self.sizes[at], -1)

    def slice(self, offset: int, size: int):
        import numpy as np

        return np.frombuffer(self.read(self.payload + offset * self.width, size * self.width), f"<u{self.width}")

    def ids(self, doc_id: int, repeat: int = 0):
        """The ids of one document, or None; repeats count from this shard's first."""
        offset, size = (int(x[0]) for x in self.places([doc_id], [repeat]))
        return None if offset < 0 else self.slice(offset, size)


def open_shard(uri: str, whole: bool = False) -> Shard:
    """A shard by its URI: its index is read, and then the slices that are asked for (or, for many keys, the whole file at once)."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    f = system.open_input_file(path)
    if not whole:
        return Shard(lambda at, size: f.read_at(size, at))
    with f:
        data = memoryview(f.read())
    return Shard(lambda at, size: data[at : at + size])


MANIFEST = "part int, seq int, uri string, first_id long, first_repeat long, last_id long, n_last long, n_docs long, n_ids long"
#: Shards whose first keys a task can be expected to hold (16 bytes each).
MOST_SHARDS = 8_000_000


def write_ids(docs: DataFrame, path: str, tokenizer_file: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = 32_000_000) -> DataFrame:
    """Write the shards below path (a URI of a folder that all executors reach) and return the manifest, stored there too.

    The manifest's rows are numbered (``shard``) and have the number of ids in all shards before (``start``) and the number of
    rows with their first id in earlier ranges (``before``).
    """
    spark = docs.sparkSession
    rows, parts = id_and_text(docs, id_col, text_col), int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = spark.sparkContext.broadcast(Ranges(rows, "doc_id", parts))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from zstandard import ZstdCompressor

        encoder = word_encoder(tokenizer_file)
        end, pack = np.array([end_id], encoder.kind).tobytes(), ZstdCompressor(level=1).compress
        for batch in batches:
            packed = [pack(ids + end) for ids in encoder.encode_all(batch.column(2).to_pylist())]
            part = ranges.value.of(id_array(batch.column(0)), batch.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), *batch.columns[:2], pa.array(packed, pa.binary())], names=["part", "doc_id", "tie", "ids"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from zstandard import ZstdDecompressor

        unpack, part = ZstdDecompressor().decompress, None
        system, folder = fs.FileSystem.from_uri(path)
        system.create_dir(folder, recursive=True)
        ids, repeats, payloads, held, seq, kind = [], [], [], 0, 0, word_encoder(tokenizer_file).kind
        width = int(kind[2:])

        def close() -> pa.RecordBatch:
            name = f"{part:06d}-{seq:04d}-{uuid.uuid4().hex}.ids"
            with system.open_output_stream(f"{folder}/{name}") as f:
                for piece in shard_bytes(ids, repeats, payloads, kind):
                    f.write(piece)
            row = [part, seq, f"{path}/{name}", ids[0], repeats[0], ids[-1], repeats[-1] + 1, len(ids), held // width]
            return pa.RecordBatch.from_pylist([dict(zip(names, row, strict=True))], schema=pa.schema(list(zip(names, types, strict=True))))

        names = [c.split()[0] for c in MANIFEST.split(", ")]
        types = [pa.int32(), pa.int32(), pa.string(), *[pa.int64()] * 6]
        last, repeat = None, 0
        for batch in batches:
            for own, doc_id, _, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != part:
                    if ids:
                        yield close()
                    ids, repeats, payloads, held, seq, part, last = [], [], [], 0, 0, own, None
                doc_id = NULL_ID if doc_id is None else doc_id
                repeat = repeat + 1 if doc_id == last else 0
                last = doc_id
                ids.append(doc_id)
                repeats.append(repeat)
                payloads.append(unpack(packed))
                held += len(payloads[-1])
                if held >= shard_ids * width:
                    yield close()
                    ids, repeats, payloads, held, seq = [], [], [], 0, seq + 1
        if ids:
            yield close()

    keyed = rows.select("doc_id", F.xxhash64("text").alias("tie"), "text")
    encoded = keyed.mapInArrow(encode, "part int, doc_id long, tie long, ids binary")
    sorted_ = encoded.repartitionById(parts, "part").sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "tie", "ids")
    sorted_.mapInArrow(write, MANIFEST).write.parquet(f"{path}/shards")
    shards = spark.read.parquet(f"{path}/shards")
    order = W.orderBy("part", "seq")  # over one row for each shard
    shards = shards.withColumn("shard", (F.row_number().over(order) - 1).cast("int"))
    shards = shards.withColumn("start", F.coalesce(F.sum("n_ids").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    # Of an id that ends one range and begins the next, the rows of all ranges before; the last shard of each range counts.
    last = F.coalesce(F.lead("part").over(order) != F.col("part"), F.lit(True))
    ends = shards.withColumn("n", F.when(last, F.col("n_last")).otherwise(0))
    before = F.coalesce(F.sum("n").over(W.partitionBy("last_id").orderBy("part", "seq").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = ends.withColumn("sum", before + F.col("n")).groupBy("last_id", "part").agg(F.max("sum").alias("sum"))
    earlier = shards.select("shard", "part", "first_id").join(sums.select(F.col("last_id").alias("first_id"), F.col("part").alias("p"), "sum"), "first_id").where("p < part").groupBy("shard").agg(F.max("sum").alias("before"))
    shards.join(earlier, "shard", "left").withColumn("before", F.coalesce("before", F.lit(0))).write.parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


def read_ids(keys: DataFrame, manifest: DataFrame, each, out: pa.Schema, schema: str) -> DataFrame:
    """Look up keys (doc_id, repeat) in the shards; each(start, ids as unsigned 32-bit array) gives further columns.

    Keys go to the task of their shard, so a shard is opened once. A key that no shard holds raises an error. The tasks
    that place the keys hold the first key of each shard, 16 bytes; beyond MOST_SHARDS larger shards are asked for.
    """
    import numpy as np

    n = manifest.count()
    if n > MOST_SHARDS:
        raise ValueError(f"{n} shards: write larger ones")
    firsts = manifest.orderBy("shard").select("first_id", (F.col("first_repeat") + F.col("before")).alias("r")).toLocalIterator()
    firsts = np.fromiter((x for r in firsts for x in r), np.int64, 2 * n).reshape(n, 2)
    held = keys.sparkSession.sparkContext.broadcast((firsts[:, 0].copy(), firsts[:, 1].copy()))
    parts = max(1, int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from bisect import bisect_right

        ids, repeats = held.value
        for batch in batches:
            key, repeat = id_array(batch.column(0)), batch.column(1).to_numpy()
            low, high = np.searchsorted(ids, key, "left"), np.searchsorted(ids, key, "right")
            at = high - 1
            for i in np.flatnonzero(high > low):  # the id is a shard's first: its number decides
                at[i] = bisect_right(repeats, repeat[i], int(low[i]), int(high[i])) - 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32))], names=["doc_id", "repeat", "shard"])

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, shard = None, None
        for batch in batches:
            ids, repeats, at = id_array(batch.column(0)), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            starts, before = (batch.column(i).fill_null(0).to_numpy(zero_copy_only=False) for i in (4, 5))
            found = []
            cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if at[a] < 0:
                    raise KeyError("a document is in no shard")
                if opened != at[a]:
                    opened, shard = at[a], open_shard(batch.column(3)[a].as_py(), whole=True)
                    first = held.value[0][opened]
                own = repeats[a:b] - np.where(ids[a:b] == first, before[a], 0)
                offsets, sizes = shard.places(ids[a:b], own)
                if (offsets < 0).any():
                    raise KeyError("a document is in no shard")
                found += [each(int(starts[a]) + o, shard.slice(o, n).astype("<u4")) for o, n in zip(offsets.tolist(), sizes.tolist(), strict=True)]
            if found:
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), list(out)[1:], strict=True))], schema=out)

    placed = keys.select("doc_id", "repeat").mapInArrow(place, "doc_id long, repeat long, shard int")
    placed = placed.join(manifest.select("shard", "uri", "start", "before"), "shard", "left").select("doc_id", "repeat", "shard", "uri", "start", "before")
    return placed.repartitionById(parts, F.pmod("shard", F.lit(parts))).sortWithinPartitions("shard").mapInArrow(look_up, schema)


def document_keys(docs: DataFrame, id_col: str = "doc_id", chunk: int = 65_536) -> DataFrame:
    """(doc_id, repeat) of every row."""
    counted = docs.select(F.col(id_col).cast("long").alias("doc_id")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    firsts = counted.select("doc_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(chunk).cast("long"))).alias("a"))
    return firsts.select("doc_id", F.explode(F.sequence(F.col("a"), F.least(F.col("a") + chunk, F.col("n")) - 1)).alias("repeat"))


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = documents(spark, sf_dir)
    path = f"{shared_dir(spark).rstrip('/')}/ids-{uuid.uuid4().hex}"
    manifest = write_ids(docs, path, public_tokenizers.path("word_bpe_49k.json"))
    out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    return read_ids(document_keys(docs), manifest, lambda start, ids: (start, len(ids), zlib.crc32(ids.tobytes())), out, "doc_id long, start long, n_tokens long, ids_crc32 long")


QUERIES = {"op6_token_output": op6_token_output}
SQL: dict[str, str] = {}
