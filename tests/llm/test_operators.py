import base64
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kgloom.llm import bpe, imatch, media, mixing, quality, simhash, suffix_dedup, token_counts, token_output, url_filter
from kgloom.llm.common import shared_dir
from tests.llm.data import documents, passage, plain

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# ---------------------------------------------------------------- 1


def repeated(found, size):
    """Covered words by brute force: {(doc_id, word span, kept)}."""
    at, words = {}, []
    for i, t in sorted(set(found), key=lambda x: (x[0] is not None, x[0] or 0, x[1])):
        spans = [m.span() for m in re.finditer(r"[^ \t-\r]+", t)]
        w = [t[a:b] for a, b in spans]
        words.append((i, spans, w))
        for s in range(len(w) - size + 1):
            at.setdefault(tuple(w[s : s + size]), []).append((i, s))
    out = set()
    for i, spans, w in words:
        for s in range(len(w) - size + 1):
            places = at[tuple(w[s : s + size])]
            if len(places) > 1:
                out |= {(i, p, places[0] == (i, s)) for p in spans[s : s + size]}
    return out


def covered(result, texts):
    out = set()
    for r in result:
        if not (r["kept"] and r["whole"]):
            out |= {(r["doc_id"], (m.start() + r["start"], m.end() + r["start"]), r["kept"]) for m in re.finditer(r"[^ \t-\r]+", texts[r["doc_id"]][r["start"] : r["stop"]])}
    return out


def test_suffix_dedup(spark):
    shared, other = passage(1, 60), passage(2, 55)
    more = [f"alpha {shared} omega", f"{passage(3)} {shared} {other}", f"start\n{other}\tend {passage(4, 30)}", passage(5, 49), passage(5, 49) + " x", f"{passage(6)} {passage(7, 20)} {passage(6)}"]
    docs = documents(spark, more=more)
    texts = dict(plain(docs))
    found = suffix_dedup.repeated_passages(docs).collect()
    want = repeated(plain(docs), 50)
    got = covered(found, texts)
    copies = {r["doc_id"] for r in found if r["whole"] and r["kept"]}
    assert got <= want and {x for x in want - got if not (x[2] and x[0] in copies)} == set()
    assert any(r["doc_id"] == 12 and not r["kept"] and r["first_id"] == 11 and r["n_words"] == 60 for r in found)
    left = suffix_dedup.without_repeats(docs)
    assert left.columns == docs.columns
    after = {r["doc_id"]: r for r in left.collect()}
    assert shared in after[11]["text"] and shared not in after[12]["text"] and after[12]["n_chars"] == len(after[12]["text"])
    assert 14 in after and after[3]["text"] == "one" and after[0]["text"] is None
    assert not {x for x in repeated([(i, r["text"] or "") for i, r in after.items()], 50) if x[0] != 9}


def test_cuts_go_by_id_and_text(spark):
    shared, a, b = passage(71, 60), passage(72, 120), passage(73, 120)
    rows = [(3, shared), (7, f"{shared} {a}"), (7, b), (None, f"x {shared} y"), (None, a.upper())]
    left = suffix_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    texts = [(r["doc_id"], r["text"].strip()) for r in left]
    assert (7, a) in texts and (7, b) in texts and (None, a.upper()) in texts and (None, f"x {shared} y") in texts and len(left) == 4


@pytest.mark.parametrize("size", [1, 7])
def test_suffix_dedup_random(spark, size):
    rng = random.Random(size)
    texts = [" ".join(rng.choices("ab", k=rng.randint(0, 60))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    found = suffix_dedup.repeated_passages(docs, min_words=14, window=15 - max(size, 2), size=size).collect()
    want, copies = repeated(list(enumerate(texts)), 14), {r["doc_id"] for r in found if r["whole"] and r["kept"]}
    got = covered(found, dict(enumerate(texts)))
    assert got <= want and {x for x in want - got if not (x[2] and x[0] in copies)} == set()


# ---------------------------------------------------------------- 2


def groups(prints, radius):
    """{distinct fingerprint: representative} by brute force."""
    distinct = sorted(set(prints))
    root = {x: x for x in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= radius:
                root[find(a)] = find(b)
    return {x: find(x) for x in distinct}


@pytest.mark.parametrize("radius", [0, 1, 2])
def test_masks_cover(radius):
    rng = random.Random(radius)
    for _ in range(2000):
        diff = sum(1 << b for b in rng.sample(range(64), rng.randint(0, radius)))
        assert any(m & diff == 0 for m in simhash.masks(radius))


@pytest.mark.parametrize("radius, most", [(2, 4096), (2, 3), (1, 2), (0, 1)])
def test_links(spark, radius, most):
    rng = random.Random(most)
    centres = [rng.getrandbits(64) for _ in range(6)]
    prints = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for c in centres for _ in range(25)}
    signed = [x - 2**64 if x >> 63 else x for x in prints]
    from kgloom.llm.common import checkpoint
    from kgloom.operators.components import connected_components

    found = connected_components(simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), radius, most), "u", "v", checkpoint).collect()
    got = {r["node"]: r["root"] for r in found}
    want = groups(signed, radius)
    for i, a in enumerate(signed):
        for b in signed[:i]:
            assert (got.get(a, a) == got.get(b, b)) == (want[a] == want[b])


def test_one_of_each_keeps_unlike_rows(spark):
    a, b, c, d, e = (passage(s, 80) for s in range(61, 66))
    rows = [(7, a), (7, b), (None, c), (None, d), (None, d), (None, e), (9, e.upper()), (3, a)]
    found = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in found) == sorted([(3, a), (7, b), (9, e.upper()), (0, c), (0, d)])


def test_one_of_similar(spark):
    rng, texts = random.Random(4), []
    for i in range(120):
        words = passage(1000 + i, (6, 20, 60, 200, 400)[i % 5]).split()
        texts.append(" ".join(words))
        for j in rng.sample(range(len(words)), rng.randint(1, max(1, len(words) // 50))):
            words[j] = "new"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    sets = [set(simhash.shingle_hashes(t).tolist()) for t in texts]
    alike = [(i, j) for j in range(len(sets)) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    left = {r["doc_id"] for r in simhash.one_of_similar(docs).collect()}
    gone = set(range(len(texts))) - left
    assert gone <= {j for _, j in alike}
    assert len(alike) > 50 and len(gone) >= 0.97 * len({j for _, j in alike})
    x = np.random.default_rng(1).integers(0, 2**63, (1, 4), np.uint64) ^ (np.uint64(1) << np.arange(60, dtype=np.uint64))[:, None]
    assert len(simhash.near_pairs(np.arange(60), x, 80)) == 59  # a tree
    big = simhash.candidates(docs.select(F.xxhash64("text").alias("h"), "text"), 5, 0.8, most=3).count()
    assert big > 50


def test_near_duplicates(spark):
    long = passage(9, 400)
    docs = documents(spark, more=[long, long + " x", passage(10, 300)])
    found = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    prints = {i: simhash.fingerprint(t) for i, t in plain(docs)}
    want = groups(prints.values(), 2)
    for i, f in prints.items():
        same = [j for j, g in prints.items() if want[g] == want[f] and j is not None]
        assert found[i]["component_id"] == (min(same) if same else None)
        assert found[i]["fingerprint"] == f"{f:016x}"
    assert found[0]["fingerprint"] == "0" * 16 and found[2]["component_id"] == 0 and found[6]["component_id"] == 5
    left = simhash.one_of_each(docs)
    assert left.columns == docs.columns
    kept = [r["doc_id"] for r in left.collect()]
    assert len(kept) == len(set(kept)) == len({want[f] for f in prints.values()})
    # plain bit by bit definition
    text = b"a b c d"
    hashes = [__import__("xxhash").xxh64_intdigest(s, 42) for s in (b"a b c", b"b c d")]
    assert simhash.fingerprint(text.decode().upper()) == sum(1 << i for i in range(64) if sum(h >> i & 1 for h in hashes) * 2 > 2)
    assert spark.createDataFrame([("é a b",)], "t string").select(F.xxhash64("t")).head()[0] & (2**64 - 1) == __import__("xxhash").xxh64_intdigest("é a b".encode(), 42)


# ---------------------------------------------------------------- 3, 6, 10


def test_token_counts(spark):
    import sentencepiece

    docs = documents(spark)
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    found = rows(token_counts.token_counts(docs, public_tokenizers.path("piece_bpe_32k.model"), limit=100))
    assert found == sorted(((i, len(t.encode()), n := len(model.encode(t)), n > 100) for i, t in plain(docs)), key=repr)


PIECES = token_counts.Segments(public_tokenizers.path("piece_bpe_32k.model"), most=50)
WORDS = token_output.WordEncoder(public_tokenizers.path("word_bpe_49k.json"), most=20)
BYTES = bpe.TextCoder(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, most=50)
TEXT = st.text(st.one_of(st.sampled_from(" \n\t\r.'▁aAeßéЖ漢😀1²<|>"), st.characters(codec="utf-8")), max_size=60)


@settings(max_examples=150, deadline=None)
@given(TEXT)
def test_encoders_equal_the_libraries(text):
    import tiktoken

    assert PIECES.count(text) == len(PIECES.model.encode(text))
    assert WORDS.encode(text) == np.array(WORDS.tokenizer.encode(text, add_special_tokens=False).ids, "<u2").tobytes()
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=BYTES.coder.ranks, special_tokens={})
    ids = BYTES.encode(text)
    assert ids == known.encode_ordinary(text) and BYTES.decode(ids) == text.encode()


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=80), st.binary(max_size=8), st.data())
def test_prefix_coder_edits(data, put, draw):
    coder = BYTES.coder
    last = coder.extend(data)
    start = draw.draw(st.integers(0, len(data)))
    stop = draw.draw(st.integers(start, len(data)))
    new, again, _ = coder.edit(data, last, start, stop, put)
    assert new == data[:start] + put + data[stop:] and again == coder.extend(new)
    assert coder.extend(data + put, list(last)) == coder.extend(data + put)
    assert coder.decode(coder.read(new, again)) == new


def test_edits_stop_early():
    coder = BYTES.coder
    data = b" the quick brown fox" * 200
    last = coder.extend(data)
    new, again, done = coder.edit(data, last, 10, 12, b"zz")
    assert again == coder.extend(new) and done < 1000


def test_bpe(spark):
    docs = documents(spark)
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    found = rows(bpe.coders(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN))
    assert found == sorted(((i, len(x := known.encode_ordinary(t)), sha(",".join(map(str, x)).encode()), sha(t.encode())) for i, t in plain(docs)), key=repr)


@pytest.mark.parametrize("shard_ids", [10, 32_000_000])
def test_token_output(spark, shard_ids):
    import pyarrow as pa
    from tokenizers import Tokenizer

    docs = documents(spark)
    path = f"{shared_dir(spark)}/test-ids-{random.getrandbits(60):x}"
    manifest = token_output.write_ids(docs, path, public_tokenizers.path("word_bpe_49k.json"), shard_ids=shard_ids)
    out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n", pa.int64()), ("crc", pa.int64())])
    found = sorted(rows(token_output.read_ids(token_output.document_keys(docs), manifest, lambda start, ids: (start, len(ids), zlib.crc32(ids.tobytes())), out, "doc_id long, start long, n long, crc long")), key=lambda r: r[1])
    known, want, start = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), [], 0
    for i, t in sorted(plain(docs), key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = np.array([*known.encode(t, add_special_tokens=False).ids, 1], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert found == want
    uri = manifest.orderBy(F.desc("part"), F.desc("seq")).head()["uri"]
    assert token_output.open_shard(uri).ids(123_456_789) is None


@settings(max_examples=40, deadline=None)
@given(st.sets(st.integers(-(2**63), 2**63 - 1), min_size=1, max_size=300))
def test_perfect_hash(keys):
    k = np.array(sorted(keys), np.int64).view(np.uint64)
    index = token_output.PerfectHash.build(k)
    assert sorted(index.slots(k).tolist()) == list(range(len(k)))


# ---------------------------------------------------------------- 4


def water(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    """Targets by clamping and sharing anew until all are feasible."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    free, left, out = set(order), share * sum(sizes.values()), {}
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > cap * sizes[s]}
        if not over:
            return out | {s: level * w[s] for s in free}
        out |= {s: cap * sizes[s] for s in over}
        left -= sum(cap * sizes[s] for s in over)
        free -= over
    return out


@pytest.mark.parametrize("seed", range(3))
def test_mixing(spark, seed):
    rng = random.Random(seed)
    docs = documents(spark, more=[passage(rng.getrandbits(30), rng.randint(1, 300)) for _ in range(150)])
    found = mixing.mix(docs).collect()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for r in docs.collect():
        sizes[r["source"]] = sizes.get(r["source"], 0) + count(r["text"])
    want, taken = water(sizes), {}
    assert len(found) == docs.count()
    for r in found:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    assert rows(mixing.mix(docs.repartition(7))) == sorted((tuple(r) for r in found), key=repr)
    mixed = mixing.mixed_rows(docs)
    assert mixed.columns == docs.columns
    out = mixed.collect()
    by = {}
    for r in out:
        by[r["source"]] = by.get(r["source"], 0) + count(r["text"])
        assert r["n_chars"] == len(r["text"] or "")
    assert all(abs(by.get(s, 0) - want[s]) <= 2 for s in sizes)


# ---------------------------------------------------------------- 5


def test_imatch(spark):
    docs = documents(spark, more=[passage(i, 120) for i in range(40)] + [passage(0, 120) + " changed"])
    found = imatch.fingerprints(docs, 0.01, 0.9).collect()
    order = sorted(plain(docs), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    want = {}
    for k, (i, t) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        n = len(t) // 2
        want.setdefault(i, []).append((len(t), hashlib.sha256((t[: len(t) - n] + following[:n]).encode()).hexdigest()))
    got, prints = {}, {}
    for r in found:
        got.setdefault(r["doc_id"], []).append((r["n_chars"], r["edited_sha256"]))
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        prints[r["doc_id"]] = r["fingerprint"]
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert prints[5] == prints[6] and prints[0] == prints[1] and len({prints[i] for i in range(11, 51)}) == 40
    assert imatch.likeness(prints[11], prints[51]) > 0.6 > imatch.likeness(prints[11], prints[12])
    one = spark.createDataFrame([(3, "alone here")], "doc_id long, text string")
    assert imatch.fingerprints(one).head()["near_next"] == 1.0


# ---------------------------------------------------------------- 7


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://WWW.Example.com/en/x?q#f", "https://a.example.com/en/1", "http://b.net/es/2/", "http://b.net/de/2", "http://x.org/en/5.html", "http://com/y", "http://notcom.example.org/", "http://h.com", "http://h.com?x=/a", "http://a://b/c", "http://d.net\n/fr/", "http://e.net/fr/p/q/r/s"]
    pages = spark.createDataFrame([(i, u, 1, "h") for i, u in enumerate(urls)] + [(None, "http://z.org/q", 1, "h"), (3, urls[3], 1, "h")], "page_id long, url string, t int, host string")
    found = {r["page_id"]: r for r in url_filter.url_verdicts(pages).collect()}
    assert url_filter.url_verdicts(pages).count() == len(urls) + 2
    assert (found[3]["host"], found[3]["path"], found[3]["rule"], found[3]["verdict"]) == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert (found[4]["rule"], found[4]["verdict"]) == ("example.com/en/", "block")
    assert (found[5]["rule"], found[5]["verdict"]) == ("net/es/", "block") and found[6]["rule"] is None
    assert (found[8]["host"], found[8]["rule"]) == ("com", "com/") and found[9]["rule"] is None and found[10]["rule"] is None
    assert (found[11]["host"], found[11]["path"]) == ("h.com", "") and (found[12]["host"], found[12]["path"]) == ("a:", "//b/c")
    assert (found[0]["host"], found[0]["path"]) == (found[2]["host"], found[2]["path"]) == ("", "")
    assert {r["verdict"] for r in found.values()} <= {"allow", "block"}


def test_templates_learn_from_labels(spark):
    """A path that is always blocked elsewhere is blocked on a host without labels."""
    urls = [f"http://h{i % 9}.com/promo/{i}" for i in range(200)] + [f"http://h{i % 9}.com/news/{i}" for i in range(200)] + ["http://new.org/promo/777", "http://new.org/news/777"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = (("block", "com/promo/"), ("allow", "com/news/"))
    found = {r["page_id"]: r["verdict"] for r in url_filter.url_verdicts(pages, rules).collect()}
    assert found[400] == "block" and found[401] == "allow"


# ---------------------------------------------------------------- 8


def test_quality(spark):
    docs, labels = spark.read.parquet(f"{SF}/../sf0.01/documents.parquet"), spark.read.parquet(f"{SF}/../sf0.01/labels.parquet")
    found = {r["doc_id"]: r for r in quality.quality_scores(docs, labels).collect()}
    known = {r["doc_id"]: r["quality"] for r in labels.collect()}
    held = [(found[i]["predicted"], y) for i, y in known.items() if found[i]["held_out"]]
    assert all(found[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in found)
    assert sum(p == y for p, y in held) / len(held) > 0.97
    # labels of held-out rows change nothing
    other = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r["doc_id"]: r["score"] for r in quality.quality_scores(docs, other).collect()}
    assert all(abs(again[i] - found[i]["score"]) < 1e-12 for i in again)
    left = quality.good_rows(docs, labels)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.select("doc_id").collect()} == {i for i, r in found.items() if r["predicted"]}


def test_quality_odd_cases(spark):
    docs = documents(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality.quality_scores(docs, none).collect()} == {0.5}
    rules = quality.Rules(np.random.default_rng(0).random((300, len(quality.STATS))), np.arange(300) % 2)
    x = [quality.statistics(t) for _, t in plain(docs)]
    stats = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(plain(docs))], "i long, t string").select("i", quality.stats_column(F.col("t")).alias("s"))
    got = [r[0] for r in stats.orderBy("i").select(rules.column("s")).collect()]
    assert np.allclose(got, rules.scores(x)) and np.isfinite(got).all()


# ---------------------------------------------------------------- 9


def test_media(spark):
    docs = documents(spark)
    path = f"{shared_dir(spark)}/test-media-{random.getrandbits(60):x}"
    found = media.document_media(docs, path).collect()
    texts = {}
    for i, t in plain(docs):
        texts.setdefault(i, t)
    assert len(found) == docs.count()
    for r in found:
        raw = texts[r["doc_id"]].encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        image = media.to_image(payload, len(raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r["media_bytes"], r["media_sha256"], r["feature"]) == (len(image), hashlib.sha256(image).hexdigest(), media.feature(payload))
    assert media.from_image(media.to_image(b"\n5\n#" + bytes(60), 4)) == (b"\n5\n#" + bytes(60), 4)


def test_sequences(spark):
    page = '<title>T</title><p>a <b>b</b><figure><img src="sha256:1" alt="x"><figcaption>cap &amp; tion</figcaption></figure><script>no</script>tail<video src=v.mp4 title=t></video><br>end</div>'
    items = media.parse_items(page)
    assert [(x["pos"], x["kind"], x["text"] or x["ref"], x["caption"]) for x in items] == [(0, "text", "T", None), (1, "text", "a b", None), (2, "media", "sha256:1", "cap & tion"), (3, "text", "tail", None), (4, "media", "v.mp4", "t"), (5, "text", "end", None)]
    pages = spark.createDataFrame([(1, page), (2, None), (2, None), (None, "<p>x")], "page_id long, html string")
    payloads = spark.createDataFrame([("1", 64), ("2", 9)], "digest string, n long")
    found = media.resolved(media.sequences(pages), payloads).collect()
    assert sorted(len(r["items"]) for r in found) == [0, 0, 1, 6]
    whole = next(r["items"] for r in found if r["id"] == 1)
    assert [x["pos"] for x in whole] == list(range(6)) and whole[2]["payload"]["n"] == 64 and whole[4]["payload"] is None


# ---------------------------------------------------------------- all


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    p = public_tokenizers.path
    assert suffix_dedup.repeated_passages(docs).count() == suffix_dedup.without_repeats(docs).count() == 0
    assert simhash.near_duplicates(docs).count() == simhash.one_of_each(docs).count() == 0
    assert token_counts.token_counts(docs, p("piece_bpe_32k.model")).count() == 0
    assert mixing.mix(docs).count() == mixing.mixed_rows(docs).count() == 0
    assert imatch.fingerprints(docs).count() == 0
    path = f"{shared_dir(spark)}/test-empty-{random.getrandbits(60):x}"
    assert token_output.write_ids(docs, path, p("word_bpe_49k.json")).count() == 0
    assert url_filter.url_verdicts(spark.createDataFrame([], "page_id long, url string")).count() == 0
    assert quality.quality_scores(docs, labels).count() == quality.good_rows(docs, labels).count() == 0
    assert media.document_media(docs, path + "m").count() == 0
    assert bpe.coders(docs, p("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).count() == 0
