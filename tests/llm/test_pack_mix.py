import itertools
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from blattwerk.llm import mix, pack, tokens


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 12), min_size=1, max_size=30), st.integers(1, 4))
def test_bounds_are_optimal(sizes, buckets):
    h = np.bincount(sizes, minlength=13)
    got = pack.bucket_bounds(h, buckets)
    cost = lambda bs: sum(min(b for b in bs if b >= s) - s for s in sizes)
    kinds = sorted(set(sizes))
    best = min(cost(c) for k in range(1, buckets + 1) for c in itertools.combinations(kinds, min(k, len(kinds))) if c[-1] == kinds[-1])
    assert len(got) <= max(buckets, 1) and cost(got) == best


def test_pack(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([0, rng.randint(1, 40), rng.randint(1, 100), 250])) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, tokens long").selectExpr("*", "1 as r", "2 as bound", "3 as chunk", "4 as first")
    got = pack.pack(df, "doc_id", 100, buckets=30).collect()
    use: dict = {}
    for r in got:
        use[r.behaelter] = use.get(r.behaelter, 0) + r.tokens
    assert max(use.values()) <= 100
    parts: dict = {}
    for r in got:
        parts.setdefault(r.doc_id, []).append((r.teil, r.tokens))
    assert {k: sum(t for _, t in v) for k, v in parts.items()} == dict(rows)
    assert all(len(v) == max(1, -(-dict(rows)[k] // 100)) and sorted(n for n, _ in v) == list(range(len(v))) for k, v in parts.items())
    assert len(use) <= 1.05 * sum(t for _, t in rows) / 100 + 1
    assert pack.pack(df.limit(0), "doc_id", 100).count() == 0


def test_mixture(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice("aaaaaabbc") if i % 50 else None, rng.randint(0, 300)) for i in range(3000)] + [(9000, "d", 100)]
    df = spark.createDataFrame(rows, "doc_id long, source string, tokens long").withColumn("block", F.lit(1)).withColumn("chunk", F.lit(2)).select("doc_id", "source", "tokens")
    target = spark.createDataFrame([("a", 0.5, 1), ("b", 0.2, 2), ("c", 0.25, 4), ("d", 0.05, 4), ("leer", 0.0, 1)], "source string, anteil double, max_wiederholungen int")
    total = sum(t for *_, t in rows)
    got = mix.mixture(df, target, 60, 1000).collect()
    uses: dict = {}
    by: dict = {}
    for r in got:
        uses[r.doc_id] = uses.get(r.doc_id, 0) + 1
        by[r.source] = by.get(r.source, 0) + r.tokens
    cap = {"a": 1, "b": 2, "c": 4, "d": 4}
    src = {i: s for i, s, _ in rows}
    assert all(n <= cap[src[i]] for i, n in uses.items())
    for s, share in (("a", 0.5), ("b", 0.2), ("c", 0.25)):
        assert abs(by[s] - share * 0.6 * total) <= 151
    assert by["d"] == 400  # all that it has, four times
    assert len({(r.doc_id, r.wiederholung) for r in got}) == len(got)
    places = {(r.platz, r.source, r.block) for r in got}
    assert sorted(p for p, *_ in places) == list(range(len(places)))  # dense, and one block to a place
    order = sorted(got, key=lambda r: (r.platz, r.ab))
    for m in range(20, len(places), 20):  # every stretch from the start has about its shares
        upto = [s for p, s, _ in places if p < m]
        for s in "abcd":
            n = sum(x == s for _, x, _ in places)
            assert abs(upto.count(s) - m * n / len(places)) <= 2
    half = [r for r in order[: len(order) // 2]]
    a = sum(r.tokens for r in half if r.source == "a") / sum(r.tokens for r in half)
    assert abs(a - by["a"] / sum(by.values())) < 0.05
    rep = {r.source: r for r in mix.shares(df, target, 60).collect()}
    assert rep["a"].token == by["a"] and rep["leer"].token == 0 and rep["c"].haeufigste <= 4
    assert mix.mixture(df.limit(0), target, 60).count() == 0


def test_tokens(spark):
    texts = ["Die Welle läuft.", "", None, "wort " * 50_000, "x" * 250_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: r.tokens for r in tokens.count_tokens(df, ["doc_id"]).collect()}
    assert got[1] == got[2] == 0 and got[0] > 3 and got[3] >= 50_000 and got[4] > 0


def test_places_beyond_one_chunk(spark, monkeypatch):
    monkeypatch.setattr(mix, "CHUNK", 7)
    blocks = spark.createDataFrame([("a", b) for b in range(0, 100, 2)] + [("b", 3), ("c", 0), ("c", 9)], "source string, block long")
    got = mix.schedule(blocks).orderBy("platz").collect()
    assert [r.platz for r in got] == list(range(53)) and [r.block for r in got if r.source == "a"] == list(range(0, 100, 2))
    assert mix.schedule(blocks.limit(0)).count() == 0
