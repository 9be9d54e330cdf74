import re

import duckdb
import public_tokenizers
import pytest

from kgloom import llm
from kgloom.llm import bpe, quality, simhash

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    """Each stage against what it must do to its own input."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    held = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, held, SF).cache()
        kept[name] = (held.collect(), out.collect())
        if name != "bpe":
            assert out.columns == columns
        held = out
    before, after = kept["quality"]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rules = quality.fit(quality.document_stats(docs), labels)
    good = rules.scores([quality.statistics(r["text"]) for r in before]) >= 0.5
    assert sorted(r["doc_id"] for r in after) == sorted(r["doc_id"] for r, g in zip(before, good, strict=True) if g)
    before, after = kept["simhash"]
    prints = {r["doc_id"]: simhash.fingerprint(r["text"]) for r in before}
    left = []
    reach = {}
    for i in sorted(prints):
        near = [j for j in reach if (prints[j] ^ prints[i]).bit_count() <= 2]
        roots = {reach[j] for j in near}
        for j in reach:
            if reach[j] in roots:
                reach[j] = min(roots | {i})
        reach[i] = min(roots | {i})
    left = sorted(set(reach.values()))
    assert sorted(r["doc_id"] for r in after) == left
    before, after = kept["suffix_dedup"]
    texts = {r["doc_id"]: r["text"] for r in before}
    seen = set()
    for r in after:
        words = re.findall(r"[^ \t-\r]+", r["text"])
        for s in range(len(words) - 49):
            key = tuple(words[s : s + 50])
            assert key not in seen or r["text"] == texts[r["doc_id"]]
            seen.add(key)
    before, after = kept["mixing"]
    words = lambda rows: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in rows)
    assert abs(words(after) - 1.5 * words(before)) <= 2 * len({r["source"] for r in before})
    before, after = kept["bpe"]
    coder = bpe.TextCoder(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    assert sorted((r["doc_id"], list(r["ids"])) for r in after) == sorted((r["doc_id"], coder.encode(r["text"])) for r in before)


@pytest.mark.parametrize("name", sorted(llm.sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(llm.sql()[name])
    found = llm.queries()[name](spark, SF).select(*want.columns).collect()
    assert sorted(map(repr, (tuple(r) for r in found))) == sorted(map(repr, want.fetchall()))


def test_names():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in llm.queries()) == list(range(1, 11))
