"""Registered queries without SQL, against brute force on small tables."""

from kgloom import queries
from kgloom.operators import vectors
from tests.hand import hand_graph

SF = "/root/testdata/sf0.001"


def test_connected_merge_all(spark):
    orders = queries.table(spark, SF, "orders").where("o_orderkey % 7 = 0 OR o_orderstatus = 'P'").limit(150).collect()
    keys = [r["o_orderkey"] for r in orders]
    nations = {r["c_custkey"]: r["c_nationkey"] for r in queries.table(spark, SF, "customer").collect()}
    lines = queries.table(spark, SF, "lineitem").where(queries.F.col("l_orderkey").isin(keys)).collect()
    parts = {}
    for r in lines:
        parts.setdefault(r["l_orderkey"], set()).add(r["l_partkey"])
    held = [(nations[r["o_custkey"]], {r["o_orderkey"]}, set(parts[r["o_orderkey"]]), r["o_totalprice"]) for r in orders if r["o_orderkey"] in parts and r["o_custkey"] in nations]
    merged = True
    while merged:
        merged = False
        for i, a in enumerate(held):
            j = next((j for j in range(i) if held[j][0] == a[0] and held[j][2] & a[2]), None)
            if j is not None:
                b = held[j]
                held[j] = (a[0], a[1] | b[1], a[2] | b[2], max(a[3], b[3]))
                del held[i]
                merged = True
                break
    want = {(q, f"{min(k):012d}", "|".join(sorted(f"order{o}>part{p}" for o in k for p in parts[o])), x, len(k)) for q, k, _, x in held}
    few = spark.createDataFrame(orders)
    found = queries._order_merge(few, queries.table(spark, SF, "customer"), queries.table(spark, SF, "lineitem")).collect()
    assert {tuple(r) for r in found} == want and any(len(k) > 1 for _, k, _, _ in held)
    total = queries.QUERIES["connected_merge_all"](spark, SF).agg(queries.F.sum("merged_from")).head()[0]
    whole = queries.table(spark, SF, "orders").join(queries.table(spark, SF, "lineitem").select(queries.F.col("l_orderkey").alias("o_orderkey")).distinct(), "o_orderkey").join(queries.table(spark, SF, "customer").select(queries.F.col("c_custkey").alias("o_custkey")), "o_custkey").count()
    assert total == whole and "connected_merge_all" not in queries.SQL


def test_compile_entities_takes_all(spark, monkeypatch):
    kg, limits, plain = hand_graph(spark), [], vectors.compile_entities
    assert plain(kg, vectors.HashingEncoder(8), None).count() == kg.triples.select("s").distinct().count()
    monkeypatch.setattr(vectors, "compile_entities", lambda kg, encoder, limit: limits.append(limit) or plain(kg, encoder, limit))
    queries.compile_entities(spark, SF)
    assert limits == [None]
