"""Operators and stages against naive versions, on odd rows and clashing names."""

import hashlib
import html
import random
import re
import weakref
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kgloom.llm import bpe, common, imatch, media, mixing, quality, simhash, suffix_dedup, token_output, url_filter
from kgloom.llm.common import Ranges, shared_dir
from tests.llm.data import passage

SF = "/root/testdata/sf0.001"
EXTRA = ("_text", "_left", "row", "h", "size", "stats", "cuts", "copy", "taken", "_id", "source_size")


def odd(spark):
    """Documents of SF and odd rows, each with a tag in columns whose names operators use within."""
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    rows = [(None, passage(900 + i, 80), "en", "s1", 5) for i in range(3)] + [(7, passage(910, 90), "en", None, 5), (7, passage(911, 30), None, "s1", 5)]
    rows += [(None, None, "en", "s1", None), (8, "", "en", "s2", 0), (9, " \n", "en", "s2", 2), (9, "one two three", "en", "s2", 13), (9, "one two three", "en", "s2", 13)]
    rows += [(20_000 + i, f"{passage(920 + i, 60)} {passage(950, 60)}", "en", "s3", 1) for i in range(4)]
    every = [(*r, *[f"{n}-{i}" for n in EXTRA]) for i, r in enumerate(docs + rows)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in EXTRA)
    return spark.createDataFrame(every, schema), docs, rows


def words(text):
    return re.findall(r"[^ \t-\r]+", text or "")


def test_stages_keep_rows_whole(spark):
    import corpus_pipeline

    docs, plain, rows = odd(spark)
    held = docs.repartition(5).cache()
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, held, SF).cache()
        before, after = ({r["_text"]: r for r in held.collect()}, out.collect()) if "_text" in out.columns else (None, out.collect())
        if name == "bpe":
            assert len(after) == held.count()
            continue
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        for r in after:
            own = before[r["_text"]]
            changed = {"suffix_dedup": {"text", "n_chars"}, "mixing": {"text", "n_chars"}}.get(name, set())
            assert all(r[c] == own[c] for c in docs.columns if c not in changed)
        kept[name] = (before, after)
        held = out
    tags = {r["_text"] for r in kept["simhash"][1]}
    given = set(kept["simhash"][0])
    unlike = [i for i, r in enumerate(rows) if r[1] and len(words(r[1])) > 20]
    assert {f"_text-{len(plain) + i}" for i in unlike} & given <= tags
    before, after = kept["mixing"]
    assert abs(sum(len(words(r["text"])) for r in after) - 1.5 * sum(len(words(r["text"])) for r in before.values())) <= 2 * len({r["source"] for r in before.values()})


def test_stages_on_an_empty_table(spark):
    import corpus_pipeline

    docs = odd(spark)[0].limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0 and (name == "bpe" or out.columns == docs.columns)


def test_similar_stage_against_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    sets = {}
    for r in rows:
        w = (r["text"] or "").encode().lower().split()
        sets[r["doc_id"]] = {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if both and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    want = {find(i) for i in ids}
    assert {r["doc_id"] for r in simhash.stage(spark, docs, SF).collect()} == want


def test_overfull_buckets_lose_no_group(spark):
    rng, texts = random.Random(8), []
    for c in range(3):
        base = passage(700 + c, 200).split()
        for _ in range(40):
            copy = list(base)
            for _ in range(2):
                copy[rng.randrange(200)] = f"w{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    plain = simhash.candidates
    simhash.candidates = lambda *args: plain(*args, most=6)
    try:
        left = sorted(r["doc_id"] for r in simhash.one_of_similar(docs).collect())
    finally:
        simhash.candidates = plain
    assert left == [0, 40, 80]


def test_similar_stage_lets_caches_go():
    """A worker that has run an encoder does not hold its caches through the tasks of the SimHash stage."""

    class Rows:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            return run

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    gone = weakref.ref(bpe.text_coder(path, public_tokenizers.PATTERN))
    assert gone().encode("one two") and common._kept
    batch = pa.RecordBatch.from_pydict({"h": [5], "text": ["a b c d e f"]})
    assert [b.column(0).to_pylist() for b in simhash.sketches(Rows(), 5, 0.8)(iter([batch]))] == [[5]]
    assert not common._kept and gone() is None


@pytest.mark.parametrize("most", [25, 2048])
def test_crowded_buckets_lose_no_link(spark, monkeypatch, most):
    """Texts that are all candidates of each other, some of them just within the threshold."""
    rng, base, texts = random.Random(345), passage(345, 345).split(), []
    for _ in range(150):
        copy = list(base)
        for at in rng.sample(range(345), 5):
            copy[at] = f"w{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    sets = [set(simhash.shingle_hashes(t).tolist()) for t in texts]
    group = list(range(150))
    for j in range(150):
        for i in range(j):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                group = [min(group[i], group[j]) if g in (group[i], group[j]) else g for g in group]
    assert 10 < len(set(group)) < 140
    plain, rest = simhash.candidates, simhash.across
    monkeypatch.setattr(simhash, "candidates", lambda *args: plain(*args, most=most))
    monkeypatch.setattr(simhash, "across", lambda *args: rest(*args, most=most))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert sorted(r["doc_id"] for r in simhash.one_of_similar(docs).collect()) == sorted(set(group))


@pytest.mark.parametrize("most", [2, 8192])
def test_repeats_of_frequent_suffixes(spark, most):
    rng = random.Random(5)
    shared = [passage(i, 40) for i in range(3)]
    texts = [" ".join([passage(100 + i, rng.randint(0, 20)), rng.choice(shared), rng.choice(shared), passage(200 + i, 9)]) for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = suffix_dedup.repeated_passages(docs, min_words=30, window=12, size=5, most=most).collect()
    at = {}
    for i, t in enumerate(texts):
        w = words(t)
        for s in range(len(w) - 29):
            at.setdefault(tuple(w[s : s + 30]), []).append((i, s))
    want = {}
    for places in at.values():
        if len(places) > 1:
            for i, s in places:
                want.setdefault(i, set()).update(range(s, s + 30))
    got = {}
    for r in found:
        first = len(words(texts[r["doc_id"]][: r["start"]]))
        got.setdefault(r["doc_id"], set()).update(range(first, first + r["n_words"]))
        assert len(words(texts[r["doc_id"]][r["start"] : r["stop"]])) == r["n_words"]
    assert got == want


def test_frequent_suffixes_are_looked_up_by_block(spark, monkeypatch):
    """A row for each document and for each distinct window of a block, not for each window of each suffix; the same spans."""
    shared = passage(61, 70)
    texts = [f"{passage(3000 + i, 30)} {shared} {passage(5000 + (i // 2 if i < 40 else i), 30)}" for i in range(600)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows, taken = {}, []
    plain, joined = suffix_dedup.stored, suffix_dedup.lookups

    def counting(df, name):
        out = plain(df, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(suffix_dedup, "stored", counting)
    monkeypatch.setattr(suffix_dedup, "lookups", lambda found: (taken.append((found, out := joined(found))), out)[1])
    want, got = (sorted(map(tuple, suffix_dedup.repeated_passages(docs, most=most).collect())) for most in (8192, 100))
    assert got == want and len(got) >= 600
    assert rows["contexts"] <= rows["shared"]
    ((found, out),) = taken
    assert found.count() == 600 and 4 <= found.select("block").distinct().count() < 10
    assert out.count() == out.select("block", "w", "x").distinct().count() < 2000 < 600 * 21  # 21 windows lie within the passage


def test_mixing_of_repeated_ids(spark):
    rng = random.Random(2)
    rows = [(None, passage(i, rng.randint(1, 30)), f"s{i % 2}") for i in range(60)] + [(5, "same words here", "s0")] * 40 + [(6, passage(99, 12), "s1")] * 3 + [(i, passage(i, 20), "s2") for i in range(100, 130)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    found = mixing.mix(docs).collect()
    assert len(found) == len(rows)
    taken, targets = Counter(), {}
    for r in found:
        taken[r["source"]] += r["taken"]
        targets[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    assert all(abs(taken[s] - t) <= 1 for s, t in targets.items())
    out = Counter()
    for r in mixing.mixed_rows(docs).collect():
        out[r["source"]] += len(words(r["text"]))
    assert out == taken


def test_ranges_divide_a_hot_id(spark):
    rows = spark.createDataFrame([(None if i % 7 == 0 else 5 if i % 3 else i,) for i in range(3000)], "doc_id long")
    ranges = Ranges(rows, "doc_id", 12)
    ids = np.array([token_output.NULL_ID if i % 7 == 0 else 5 if i % 3 else i for i in range(3000)])
    ties = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 3000)
    part = ranges.of(ids, ties)
    order = np.lexsort((ties, ids))
    assert (np.diff(part[order]) >= 0).all() and np.bincount(part, minlength=12).max() < 2.5 * 3000 / 12


def test_token_output_of_a_hot_id(spark):
    import pyarrow as pa
    from tokenizers import Tokenizer

    rows = [(5 if i % 3 else (None if i % 2 else i), passage(i, 1 + i % 9)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    path = f"{shared_dir(spark)}/test-hot-{random.getrandbits(60):x}"
    manifest = token_output.write_ids(docs, path, public_tokenizers.path("word_bpe_49k.json"), shard_ids=400)
    out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.list_(pa.int64()))])
    found = sorted((r["start"], r["doc_id"], tuple(r["ids"])) for r in token_output.read_ids(token_output.document_keys(docs, chunk=16), manifest, lambda start, ids: (start, ids.tolist()), out, "doc_id long, start long, ids array<long>").collect())
    known, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), Counter()
    for i, t in rows:
        want[i, tuple([*known.encode(t, add_special_tokens=False).ids, 1])] += 1
    assert Counter((i, ids) for _, i, ids in found) == want
    at, last = 0, token_output.NULL_ID
    for start, i, ids in found:
        assert start == at and (token_output.NULL_ID if i is None else i) >= last
        at, last = at + len(ids), token_output.NULL_ID if i is None else i
    shards = manifest.orderBy("shard").collect()
    assert sum(r["n_docs"] for r in shards) == 300 and any(r["before"] > 0 for r in shards) and [r["start"] for r in shards] == [sum(x["n_ids"] for x in shards[:n]) for n in range(len(shards))]
    lone = next(r for r in shards if r["first_id"] not in (5, token_output.NULL_ID))
    shard, reads = token_output.open_shard(lone["uri"]), []
    plain = shard.read
    shard.read = lambda at, size: reads.append(size) or plain(at, size)
    assert tuple(shard.ids(lone["first_id"])) == next(ids for _, i, ids in found if i == lone["first_id"]) and sum(reads) < 4 * 200
    with pytest.raises(Exception, match="no shard"):
        token_output.read_ids(spark.createDataFrame([(987_654_321, 0)], "doc_id long, repeat long"), manifest, lambda start, ids: (start, []), out, "doc_id long, start long, ids array<long>").collect()


@pytest.mark.parametrize("form", ["a{}b", "{}\u0301 1{}", "\u03aa{}"])
def test_encoders_on_all_code_points(form):
    import tiktoken

    coder = bpe.TextCoder(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    encoder = token_output.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.coder.ranks, special_tokens={})
    texts = [form.replace("{}", chr(c)) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x20000 or c % 211 == 0)]
    ids = encoder.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert encoder.encode_all(texts) == [np.array(x.ids, encoder.kind).tobytes() for x in ids]
    assert [t for t in texts if coder.encode(t) != known.encode_ordinary(t)] == []


def naive_items(text):
    """The items of a document's page, from its lines alone."""
    lines, out = text.split("\n"), []
    for n, line in enumerate([*lines[: len(lines) // 2], None, *lines[len(lines) // 2 :]]):
        if line is None:
            out.append(("media", f"{len(text.encode())} bytes in {len(lines)} lines"))
        elif shown := " ".join(x for x in re.split(r"[\t\n\f\r ]+", line) if x):
            out.append(("text", shown))
    return out


def test_word_encoder_of_small_caches():
    """Entries are taken over from the old generation and evicted ones encoded again, with the library's ids."""
    path = public_tokenizers.path("word_bpe_49k.json")
    encoder, rng = token_output.WordEncoder(path, most=20), random.Random(3)
    texts = [" ".join(rng.choice(["Word,", "word", "WORD", "naïve", "e\u0301t\u00e9", "a-b.c", f"w{rng.randrange(40)}x", passage(rng.randrange(30), 3)]) for _ in range(30)) for _ in range(40)]
    want = [np.array(encoder.tokenizer.encode(t, add_special_tokens=False).ids, encoder.kind).tobytes() for t in texts]
    assert encoder.encode_all(texts, group=3) == want
    memo = token_output.Generations(1)
    memo.now.update(a=1, b=2)
    assert memo.missing({"a", "c"}) == {"c"} and memo.now == {"a": 1} and memo.old == {"a": 1, "b": 2}


def test_word_encoder_splits_plain_words_itself():
    """Words of letters, alone or before one mark, need no pattern; what they give is what the library gives."""
    encoder = token_output.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))

    def find(chunk):
        raise AssertionError(chunk)

    encoder.find = find
    text = "Überall, Слово. word; été! 中文? Straße: plain"
    want = encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(encoder.encode(text), encoder.kind).tolist() == want


def test_pages_hold_whole_texts(spark):
    texts = ["", "one", "a\nb\n\nc <b>&amp; d</b>\n\x0b e\u00a0f", "<figure><figcaption>x\n</figure>\n" + passage(3, 400), passage(4, 900).replace(" ", "\n", 30), "]]>--><!-- \n <script>\nx"]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(None, None), (3, texts[1])], "doc_id long, text string").repartition(3)
    found = media.sequences(media.document_pages(docs), "doc_id", "html").collect()
    for r in found:
        text = {None: "", 3: None}.get(r["id"], texts[r["id"] or 0])
        wants = [naive_items(t) for t in ([texts[3], texts[1]] if text is None else [text])]
        got = [(x["kind"], x["text"] if x["kind"] == "text" else x["caption"]) for x in r["items"]]
        assert got in wants and [x["pos"] for x in r["items"]] == list(range(len(got)))
    path = f"{shared_dir(spark)}/test-pages-{random.getrandbits(60):x}"
    for r in media.document_media(docs, path).collect():
        text = next(t for t in ("" if r["doc_id"] is None else texts[r["doc_id"]], texts[1]) if hashlib.sha256(media.payload_of(t)).hexdigest() == r["payload_sha256"])
        items = naive_items(text)
        assert items[r["pos"]] == ("media", r["caption"]) and r["n_items"] == len(items) and r["n_bytes"] == len(text.encode())


def test_captions_are_kept():
    shown = lambda page: [(x["kind"], x["text"] or x["ref"], x["caption"]) for x in media.parse_items(page)]
    assert shown('<figure><figcaption>be<p>fore</p></figcaption><img src="a" alt="x"><img src=b></figure>') == [("media", "a", "be fore"), ("media", "b", "be fore")]
    assert shown("<figcaption>alone</figcaption>x") == [("text", "alone", None), ("text", "x", None)]
    assert shown("<figure><figcaption>no media</figcaption></figure>") == [("text", "no media", None)]
    assert shown('<figure><img src="a" title="t"><figcaption> </figcaption></figure><figure><img src="b"><figcaption>open') == [("media", "a", "t"), ("media", "b", "open")]


def test_web_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    found = {r["id"]: r["items"] for r in media.sequences(pages).collect()}
    for r in pages.collect():
        text = re.sub(r"(?is)<!--.*?-->|<(script|style|template|noscript)\b.*?</\1\s*>", " ", r["html"])
        plain = "".join(html.unescape(re.sub(r"<[^>]*>", " ", text)).split())
        got = "".join("".join(x["text"].split()) for x in found[r["page_id"]] if x["kind"] == "text")
        assert got == plain or "figcaption" in r["html"] and set(got) <= set(plain)


def _subsets(text, band):
    """For each subset of the lexicon the band's terms of a text that are in it, by integer arithmetic."""
    from xxhash import xxh64_intdigest

    mask, out = (1 << 64) - 1, []
    have = {xxh64_intdigest(t, 5) for t in set(text.lower().encode().split())} & band
    for n, density in enumerate(imatch.DENSITIES, 1):
        seed, own = n * 0x9E3779B97F4A7C15 & mask, set()
        for x in have:
            z = x ^ seed
            z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & mask
            z = (z ^ z >> 27) * 0x94D049BB133111EB & mask
            if z ^ z >> 31 <= (1 << (64 - density)) - 1:
                own.add(x)
        out.append(frozenset(own))
    return (out, have)


def _alike(a, b, x, y):
    if a[0] == b[0] and (a[1] or x == y):
        return 1.0
    if not a[1] or not b[1]:  # a text without terms of the band is like its equals only
        a, b = ((s if h else [frozenset([t])] * len(s)) for (s, h), t in ((a, x), (b, y)))
    else:
        a, b = a[0], b[0]
    best = 0.0
    for at in range(0, len(a), imatch.EACH):
        pairs = [(p, q) for p, q in zip(a[at : at + imatch.EACH], b[at : at + imatch.EACH]) if p or q]
        if 2 * len(pairs) >= imatch.EACH:
            best = max(best, sum(p == q for p, q in pairs) / len(pairs))
    return best


def test_imatch_against_a_naive_version(spark):
    from xxhash import xxh64_intdigest

    rng, vocabulary = random.Random(6), passage(1, 150).split()
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 120))) for _ in range(60)]
    texts += [texts[3], texts[4] + " more", "", "zzz", "zzz yyy"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    low, high, n = 0.05, 0.6, len(texts)
    found = {r["doc_id"]: r for r in imatch.fingerprints(docs, low, high).collect()}
    df = Counter(t for x in texts for t in set(x.lower().encode().split()))
    band = {xxh64_intdigest(t, 5) for t, k in df.items() if max(2, low * n) <= k <= max(2, high * n)}
    sets = [_subsets(t, band) for t in texts]
    for i, t in enumerate(texts):
        following = texts[(i + 1) % n]
        half = len(t) // 2
        changed = t[: len(t) - half] + following[:half]
        assert found[i]["near_next"] == pytest.approx(_alike(sets[i], sets[(i + 1) % n], t, following))
        assert found[i]["near_edited"] == pytest.approx(_alike(sets[i], _subsets(changed, band), t, changed))
        parts = lambda k: [found[k]["fingerprint"][8 * s : 8 * s + 8] for s in range(len(imatch.DENSITIES))]
        for j in range(i):
            if sets[i][1] and sets[j][1]:
                assert [a == b for a, b in zip(parts(i), parts(j))] == [a == b for a, b in zip(sets[i][0], sets[j][0])]


def naive_tree(urls, rules, depth):
    """{(url): (host, path, rule, verdict)} by a tree in plain Python."""
    rows = []
    for url in urls:
        head, mark, rest = (url or "").partition("://")
        cut = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest)) if mark else 0
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]) if mark else ""
        path = re.split(r"[?#]", rest[cut:], maxsplit=1)[0] if mark else ""
        fit = []
        for verdict, rule in rules:
            name, _, tail = rule.partition("/")
            if (host == name or host.endswith("." + name)) and path.startswith("/" + tail):
                fit.append((len(rule), rule, verdict))
        rule, verdict = max(fit)[1:] if fit else (None, None)
        rows.append({"host": host, "path": path, "rule": rule, "label": None if verdict is None else int(verdict == "block"), "t": ""})
    for r in rows:
        parts = r["path"].split("/")
        r["shape"] = []
        for seg in parts[1 : depth + 1]:
            dot = re.search(r"([.][A-Za-z]{1,5})$", seg)
            r["shape"].append("*" + (dot[1] if dot else "") if re.search("[0-9]", seg) or len(seg) > 24 else seg)
        r["deeper"] = len(parts) - 1 > depth
    for level in range(depth - 1):
        kids = {}
        for r in rows:
            if len(r["shape"]) > level:
                kids.setdefault((r["host"], r["t"]), Counter())[r["shape"][level]] += 1
        kept = {(k, s) for k, c in kids.items() for s, n in c.items() if s[:1] != "*" and (len(c) <= 20 or n * 20 >= sum(c.values()))}
        for r in rows:
            if len(r["shape"]) > level:
                s = r["shape"][level]
                r["t"] += "/" + s if s[:1] == "*" or ((r["host"], r["t"]), s) in kept else "/*"
    for r in rows:
        r["t"] += ("/" + r["shape"][depth - 1] if len(r["shape"]) == depth else "") + ("/**" if r["deeper"] else "")

    def sums(key, some):
        out = {}
        for r in some:
            m, b = out.get(key(r), (0, 0))
            out[key(r)] = (m + (r["label"] is not None), b + (r["label"] or 0))
        return out

    parent = lambda r: (r["host"], re.sub("/[^/]*$", "", r["t"]))
    own, above = sums(lambda r: (r["host"], r["t"]), rows), sums(parent, rows)
    for r in rows:
        (m, b), (pm, pb) = own[r["host"], r["t"]], above[parent(r)]
        alike = m == 0 or abs(b / m - pb / pm) <= 1.96 * ((pb + 1) * (pm - pb + 1) / (pm + 2) ** 2 / m) ** 0.5
        r["branch"] = parent(r)[1] + "/~" if alike else r["t"]
    branches, hosts, shapes = sums(lambda r: (r["host"], r["branch"]), rows), sums(lambda r: r["host"], rows), sums(lambda r: r["t"], rows)
    all_m, all_b = sum(m for m, _ in hosts.values()), sum(b for _, b in hosts.values())
    smooth = lambda mb, prior: (mb[1] + 4 * prior) / (mb[0] + 4)
    out = []
    for r in rows:
        purity = smooth(branches[r["host"], r["branch"]], smooth(hosts[r["host"]], smooth(shapes[r["t"]], (all_b + 1) / (all_m + 2))))
        block = r["label"] == 1 if r["label"] is not None else purity >= 0.5
        out.append((r["host"], r["path"], r["rule"], "block" if block else "allow"))
    return out


@pytest.mark.parametrize("depth", [3, None])
def test_url_filter_against_a_naive_tree(spark, depth):
    rng = random.Random(11)
    names = ["news", "promo", "a1", "x" * 30, "p.html", "q2.php", "", "é", *(f"w{chr(97 + i)}" for i in range(26))]
    urls = [f"http{'s' * rng.randint(0, 1)}://{rng.choice(['', 'www.', 'M.'])}{rng.choice(['one', 'two', 'three'])}.{rng.choice(['com', 'org', 'net'])}" + "".join("/" + rng.choice(names[: rng.choice([4, len(names)])]) for _ in range(rng.randint(0, 6))) + rng.choice(["", "?a/b", "#c"]) for _ in range(1500)]
    urls += [None, "", "none", "://", "a://b://c/d"]
    rules = (("block", "com/promo/"), ("allow", "com/news/"), ("block", "two.com/news/a1/"), ("block", "net/news/promo/"), ("allow", "net/news/"), ("block", "one.org/"))
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    found = sorted(tuple(r) for r in url_filter.url_verdicts(pages, rules, depth=depth).select("page_id", "host", "path", "rule", "verdict").collect())
    want = naive_tree(urls, rules, depth or max(p.count("/") for _, p, _, _ in naive_tree(urls, rules, 3)))
    assert [r[1:] for r in found] == want
    assert {v for *_, rule, v in want if rule is None} == {"allow", "block"}


def test_labels_repeat_and_tie(spark):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 3 != 1][:4]
    stats = spark.createDataFrame([(i, (float(i),)) for i in [*ids, ids[0]]], "doc_id long, stats struct<x: double>")
    labels = spark.createDataFrame([(ids[0], 1), (ids[0], 0), (ids[1], 0), (ids[1], 0), (ids[1], 1), (ids[2], None), (None, 1), (ids[3], 1)], "doc_id long, quality int")
    got = sorted((r["doc_id"], r["y"]) for r in quality.training_rows(stats, labels, 10).collect())
    assert got == sorted([(ids[0], 1.0), (ids[0], 1.0), (ids[1], 0.0), (ids[3], 1.0)])


def test_rules_travel_as_text():
    x = np.random.default_rng(4).random((400, len(quality.STATS)))
    rules = quality.Rules(x, (x[:, 0] + x[:, 3] > 1).astype(float))
    again = quality.Rules.from_json(rules.to_json())
    assert len(rules.rules) > 3 and (again.scores(x) == rules.scores(x)).all() and ((again.scores(x) > 0.5) == (x[:, 0] + x[:, 3] > 1)).mean() > 0.95


def test_scores_do_not_depend_on_labels_of_others(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    found = quality.quality_scores(docs, labels).collect()
    assert len(found) == 3 and all(0 < r["score"] < 1 for r in found)


def test_words_of_a_part_repetition(spark):
    docs = spark.createDataFrame([(1, "  a\tb \n c d", "s", 11)], "doc_id long, text string, source string, n_chars long")
    found = mixing.mixed_rows(docs).select("text", "n_chars").collect()
    assert sorted(tuple(r) for r in found) == sorted([("  a\tb \n c d", 11), ("  a\tb", 5)])


def test_links_need_no_word(spark):
    docs = spark.createDataFrame([(1, ""), (2, None), (3, " \t")], "doc_id long, text string")
    assert [r["doc_id"] for r in simhash.one_of_similar(docs.select("doc_id", F.col("text"))).collect()] == [1]
