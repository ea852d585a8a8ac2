import hashlib
import random

from pyspark.sql import functions as F

import pytest

from quillstone.operators import graphs, lineage

WIRE = "officials said on monday that the northern reservoir had reached its lowest level since records began and that restrictions would follow"
OTHER = ["a recipe for dark bread needs rye flour water salt and a good deal of patience from the baker", "the committee met to discuss parking permits and adjourned without any decision being taken at all", "astronomers described a faint comet that will be visible shortly before dawn for about two weeks"]


def traced(spark, rows, links=None):
    docs = spark.createDataFrame(rows, "id string, text string, published_at long, url string")
    edges = lineage.lineage_edges(docs, None if links is None else spark.createDataFrame(links, "id string, url string"))
    return lineage.lineage(docs, edges)


def test_independent_texts(spark):
    t = traced(spark, [(str(i), x, None, None) for i, x in enumerate(OTHER)])
    assert lineage.summary(t).first()["ics"] == 3


def test_copies_have_one_origin(spark):
    t = traced(spark, [("pr", WIRE, 1, None), *((f"c{i}", WIRE + " in the city" * (i % 2), 10 + i, None) for i in range(5)), ("undated", WIRE, None, None)])
    s = lineage.summary(t).first()
    assert (s["total"], s["ics"]) == (7, 1)
    assert {r["origin"] for r in t.collect()} == {"pr"}


def test_circular_citations(spark):
    t = traced(spark, [("a", OTHER[0], None, "http://a.example/x"), ("b", OTHER[1], None, "http://b.example/y")], [("a", "https://www.b.example/y/"), ("b", "http://a.example/x#top")])
    s = lineage.summary(t).first()
    assert (s["ics"], s["circular"]) == (1, 1)


def test_empty(spark):
    t = traced(spark, [])
    assert lineage.summary(t).first()["summary"] == "No documents to analyze."


def test_null_and_repeated_rows(spark):
    t = traced(spark, [(None, WIRE, None, None), ("x", None, None, None), ("y", "", None, None), ("z", WIRE, None, None), ("z", WIRE, None, None)])
    assert sorted(r["id"] for r in t.collect()) == ["x", "y", "z"]


def test_quotes(spark):
    docs = spark.createDataFrame([("a", OTHER[0] + " " + WIRE, 1), ("b", OTHER[1] + " " + WIRE + " " + OTHER[2], 2)], "id string, text string, published_at long")
    (e,) = lineage.quote_edges(docs).collect()
    assert (e["source"], e["target"], e["score"]) == ("a", "b", float(len(WIRE)))


def test_longest_shared_run_against_brute_force():
    rng = random.Random(5)
    for _ in range(200):
        x, y = ([rng.choice("abcd") for _ in range(rng.randrange(1, 15))] for _ in range(2))
        runs = lambda w: {tuple(w[i:j]) for i in range(len(w)) for j in range(i + 1, len(w) + 1)}
        longest = max((len(r) for r in runs(x) & runs(y)), default=0)
        got = lineage.longest_shared_run(" ".join(x), " ".join(y))
        assert len((got or "").split()) == longest


@pytest.mark.parametrize("jump, trims", [(4, 3), (1, 1)])
def test_components_and_origins_against_brute_force(spark, monkeypatch, jump, trims):
    monkeypatch.setattr(graphs, "JUMP_FROM", jump)
    monkeypatch.setattr(graphs, "TRIMS", trims)
    rng = random.Random(3)
    chain = rng.sample(range(12, 24), 12)
    edges = [(rng.randrange(12), rng.randrange(12)) for _ in range(16)] + [*zip(chain, chain[1:])]
    reach = {(i, i) for i in range(24)} | set(edges)
    for k in range(24):
        reach |= {(a, d) for a, b in reach if b == k for c, d in reach if c == k}
    want = {i: min(j for j in range(24) if (i, j) in reach and (j, i) in reach) for i in range(24)}
    sizes = [*want.values()]
    table = spark.createDataFrame([*edges, edges[0], (None, 1)], "source int, target int")
    assert {r["id"]: r["component"] for r in graphs.components(table).collect()} == {i: c for i, c in want.items() if sizes.count(c) > 1}
    starts = [chain[0], 7, 11, 60]
    got = graphs.origins(table, spark.createDataFrame([(i,) for i in starts], "id int"))
    reached = {i: min(s for s in starts if (s, i) in reach or s == i) for i in [*range(24), 60] if any((s, i) in reach or s == i for s in starts)}
    assert sorted(map(tuple, got.collect())) == sorted(reached.items())


def test_origins_of_a_long_chain_take_few_rounds(spark, monkeypatch):
    cuts = []
    monkeypatch.setattr(graphs, "cut", lambda df, cut=graphs.cut: cuts.append(1) or cut(df))
    table = spark.createDataFrame([(i, i + 1) for i in range(64)], "source int, target int")
    assert {r["origin"] for r in graphs.origins(table, spark.createDataFrame([(0,)], "id int")).collect()} == {0}
    assert len(cuts) < 24


def test_graphs_without_edges(spark):
    none = spark.createDataFrame([], "source int, target int")
    assert graphs.components(none).count() == 0
    assert [tuple(r) for r in graphs.origins(none, spark.createDataFrame([(3,)], "id int")).collect()] == [(3, 3)]


def test_texts_are_split_once_for_classes(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(lineage, "cut", lambda df, cut=lineage.cut: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or cut(df))
    docs = spark.createDataFrame([(1, "a b c a b c d"), (2, "b c a b c d a b c"), (3, "a b"), (4, "A, b!"), (5, ""), (6, None), (7, "a b c")], "id int, text string")
    classed = lineage.classes(lineage.prepared(docs))
    plans.append(classed._jdf.queryExecution().optimizedPlan().toString())
    assert sum(p.count("<[^>]*>") for p in plans) == 2  # in the condition and the value of one column
    # runs of three of 1 and 2: abc bca cab bcd, and those with cda and dab
    assert {r["id"]: (r["rep"], r["n"]) for r in classed.collect()} == {1: (1, 4), 2: (2, 6), 3: (3, 1), 4: (3, 1), 5: (5, 0), 6: (6, 0), 7: (7, 1)}


def test_signatures_are_dealt_out(spark):
    docs = spark.createDataFrame([(i, f"{WIRE} {i}") for i in range(64)] + [(64, None)], "id int, text string").coalesce(1)
    s = lineage.minhash_signatures(docs, hashes=3)
    assert s.rdd.getNumPartitions() > spark.sparkContext.defaultParallelism
    words = f"{WIRE} 7".split()
    least = [min(int.from_bytes(hashlib.sha256(f"{i}\0{' '.join(words[j : j + 3])}".encode()).digest()[:4], "little") for j in range(len(words) - 2)) for i in range(3)]
    found = {r["id"]: r["signature"] for r in s.collect()}
    assert found[7] == least and found[64] == [0xFFFFFFFF] * 3


def test_minhash_estimates(spark):
    docs = spark.createDataFrame([(1, WIRE), (2, WIRE + " soon"), (3, OTHER[0]), (4, "")], "id int, text string")
    s = lineage.minhash_signatures(docs)
    x = s.alias("x").join(s.alias("y"), F.col("x.id") < F.col("y.id")).select("x.id", F.col("y.id").alias("other"), lineage.signature_similarity(F.col("x.signature"), F.col("y.signature")).alias("e"))
    e = {(r["id"], r["other"]): r["e"] for r in x.collect()}
    assert e[1, 2] > 0.8 and e[1, 3] == 0.0 and e[1, 4] == 0.0
    assert {r["id"] for r in lineage.lsh_candidates(s).collect()} == {1, 2}
