import pytest
from pyspark.sql import functions as F

from quillstone.operators import anchoring, dates, judging, recall, reports, research, sources, verdicts, verify
from quillstone.sources.store import Store

TEXT = "The study found that daily walking reduced blood pressure by 8% over 12 weeks. Participants were adults from three cities. No adverse events were recorded in the trial."
NOW = 1_735_689_600_000


def anchored(spark, quote, text, fuzzy=False):
    return anchoring.with_anchor(spark.createDataFrame([(quote, text)], "quote string, text string"), fuzzy=fuzzy).first()["anchor"]


def test_anchor_tiers(spark):
    quote = "daily walking reduced blood pressure by 8%"
    a = anchored(spark, quote, TEXT)
    assert a["kind"] == "EXACT" and TEXT[a["start"] : a["end"]] == quote
    a = anchored(spark, "Daily   walking -- REDUCED blood pressure", TEXT)
    assert a["kind"] == "NORMALIZED" and TEXT[a["start"] : a["end"]] == "daily walking reduced blood pressure"
    changed = "daily walking reduced blood pressure by 91% over 12 weeks"
    assert not anchored(spark, changed, TEXT)["ok"]
    assert anchored(spark, "daily walking reduced blood pressure by 8% over 13 weeks participants were adults from three cities", TEXT, fuzzy=True)["kind"] == "FUZZY"
    assert anchored(spark, "the", TEXT)["reason"] == "quote too short" and anchored(spark, quote, "")["reason"] == "no document text" and anchored(spark, None, TEXT)["kind"] == "FAILED"


def test_admission(spark):
    docs = spark.createDataFrame([("d1", TEXT, None), ("d2", TEXT, "0")], "doc_id string, text string, sha256 string")
    c = spark.createDataFrame([("c1", "d1", "Participants were adults from three cities"), ("c2", "d1", "participants WERE adults from three cities"), ("c3", "d9", "Participants were adults from three cities"), ("c4", "d2", "Participants were adults from three cities")], "claim_id string, doc_id string, quote string")
    a = anchoring.admit(c, docs)
    assert {r["claim_id"]: r["anchor"]["reason"] for r in a.collect()} == {"c1": "exact", "c2": "normalized", "c3": "no document text", "c4": "integrity"}
    assert anchoring.phantom_rate(a).first()["phantom_rate"] == 0.5


def test_judge(spark):
    docs = spark.createDataFrame([(1, TEXT), (2, "Penguins live in the southern hemisphere and eat fish from the cold sea."), (3, "The claim that daily walking reduced blood pressure was debunked and is false. " + "Other sentences follow here for the sake of length.")], "doc_id int, text string")
    claims = spark.createDataFrame([("c", "Daily walking reduced blood pressure by 8% over 12 weeks")], "claim_id string, claim string")
    pairs = claims.select("claim_id", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3), F.lit(4))).alias("doc_id"))
    got = {r["doc_id"]: r for r in judging.judge(pairs, claims, docs).collect()}
    assert got[1]["verdict"] == "SUPPORTED" and got[1]["quote"] in TEXT
    assert (got[2]["verdict"], got[2]["quote"]) == ("NEUTRAL", "") and got[3]["verdict"] == "CONTRADICTED" and got[4]["verdict"] == "NEUTRAL"


@pytest.mark.parametrize(
    ("html", "url", "wayback", "want"),
    [
        ('<script type="application/ld+json">{"@graph":[{"datePublished":"2024-03-12"}]}</script>', None, None, (1710201600000, 1710201600000, "HIGH")),
        ('<meta property="article:published_time" content="2025-01-10">', None, 1685577600000, (1736467200000, 1685577600000, "SUSPECT")),
        ('<meta content="2024-08-01" name="pubdate">', "https://x.example/2024/07/15/story", None, (1722470400000, 1721001600000, "MEDIUM")),
        ("<p>none</p>", "https://x.example/2024/13/01/story", None, (None, None, "LOW")),
    ],
)
def test_dates(spark, html, url, wayback, want):
    df = spark.createDataFrame([(html, url, None, None, wayback)], "html string, url string, last_modified string, http_date string, wayback long")
    d = dates.resolve_dates(df, F.lit(1_767_225_600_000)).first()["dates"]
    assert (d["published"], d["effective"], d["confidence"]) == want


def test_credibility(spark):
    rows = [("https://www.sec.gov/x", TEXT, False), ("https://prnewswire.com/a", TEXT, False), ("https://x.example/p", TEXT + " doi 10.1234/abc", False), ("https://blog.example/p", TEXT, True), (None, None, None)]
    out = [r["credibility"] for r in sources.with_credibility(spark.createDataFrame(rows, "url string, text string, retracted boolean")).collect()]
    assert [c["kind"] for c in out] == ["primary", "aggregator", "primary", "unknown", "unknown"]
    assert out[0]["is_primary"] and not out[1]["is_primary"] and out[3]["score"] == 0


def test_recall_and_connections(spark):
    rows = [(1, "Alpha Corp bought Beta Labs last year"), (2, "Beta Labs hired Gamma Institute staff"), (3, "Nothing is shared here at all"), (4, "The stock price of Alpha Corp rose")]
    claims = spark.createDataFrame([(i, t, None, None, NOW - 48 * 3_600_000) for i, t in rows], "id int, text string, verdict string, confidence double, last_verified long")
    q = spark.createDataFrame([("q", "who bought Alpha Corp"), ("none", "zzz")], "query_id string, query string")
    top = recall.bm25(q, claims.select("id", "text")).orderBy("rank").collect()
    assert top[0]["id"] == 1 and {r["query_id"] for r in top} == {"q"}
    assert 4 not in {r["id"] for r in recall.hybrid_recall(q, claims, NOW).collect()}
    assert 4 in {r["id"] for r in recall.hybrid_recall(q, claims, NOW, fresh_only=False).collect()}
    index = recall.entity_index(claims)
    assert recall.connect(index, ["alpha corp"], ["gamma institute"]) == ["1", "2"]
    assert recall.connect(index, ["alpha corp"], ["nothing"]) == []


def test_search_splits_texts_once(spark, monkeypatch):
    rows = [(1, "rivers flood rivers"), (1, "rivers flood"), (2, None), (3, ""), (4, "Rivers, (flooding)..."), (None, "flood")]
    docs, q = spark.createDataFrame(rows, "id int, text string"), spark.createDataFrame([("q", "rivers rivers"), (None, "flood")], "query_id string, query string")
    small = sorted(map(tuple, recall.bm25(q, docs).collect()), key=str)
    assert [r[:2] for r in small if r[0]] == [("q", 1), ("q", 4)] and {r[1] for r in small if not r[0]} == {1, None}
    monkeypatch.setattr(recall, "SENT", 0)
    assert sorted(map(tuple, recall.bm25(q, docs).collect()), key=str) == small
    plans = []
    monkeypatch.setattr(recall, "cut", lambda df, cut=recall.cut: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or cut(df))
    found = recall.bm25(q, docs)
    plans.append(found._jdf.queryExecution().optimizedPlan().toString())
    assert sum(p.count("[^\\p{L}\\p{N}]+") for p in plans) == 2  # queries and texts, each once


def test_every_claim_with_a_name_starts_a_chain(spark):
    # sixty claims hold two of the asked names, the one that leads on only one of them
    rows = [*((i, n) for i in range(9, 69) for n in ("alpha", "beta")), (90, "alpha"), (90, "link"), (200, "link"), (200, "gamma"), (1000, "link"), (1000, "gamma")]
    index = spark.createDataFrame(rows, "id int, entity string")
    assert recall.connect(index, ["Alpha", "Beta"], ["Gamma"]) == ["90", "200"]


def test_adjudication(spark):
    e = [("one", "support", "a"), ("two", "support", "a"), ("two", "support", "b"), ("copies", "support", "a"), ("copies", "support", "c"), ("both", "support", "a"), ("both", "refute", "b"), ("against", "refute", "a")]
    evidence = spark.createDataFrame([(c, s, d, 60, False) for c, s, d in e], "claim string, side string, doc_id string, credibility int, is_primary boolean")
    claims = spark.createDataFrame([(c,) for c in ("one", "two", "copies", "both", "against", "none")], "claim string")
    r = verdicts.adjudicate(claims, evidence, spark.createDataFrame([("a", "c")], "source string, target string"))
    got = {x["claim"]: x for x in r.collect()}
    assert {c: x["verdict"] for c, x in got.items()} == {"one": "PARTIAL", "two": "SUPPORTED", "copies": "PARTIAL", "both": "PARTIAL", "against": "CONTRADICTED", "none": "UNVERIFIED"}
    assert got["both"]["contested"] and got["both"]["confidence"] <= 0.4 and got["two"]["confidence"] > got["one"]["confidence"]
    assert reports.verdict_report(r).count() == 6 and verdicts.coverage(r).first()["questions"] == 6


def test_decomposition():
    assert research.decompose("") == [] and research.decompose("x", 1) == ["x"]
    assert research.decompose("Is Rust or Go better for backend services") == ["Is Rust or Go better for backend services", "Rust for backend services", "Go better for backend services"]
    assert len(research.decompose("Does coffee help")) == 3
    assert research.base_question("Does coffee help evidence study data", "other") == "Does coffee help"


def test_research_without_search(spark):
    docs = spark.createDataFrame([(1, TEXT)], "doc_id int, text string")
    assert research.research("q", docs, None).stop == "unavailable"
    assert "could not run" in reports.research_report(research.research("q", docs, None))


def test_verify(spark):
    docs = spark.createDataFrame([(1, TEXT), (2, TEXT), (3, "Penguins eat fish from the cold southern sea all winter long.")], "doc_id int, text string")
    claims = spark.createDataFrame([("c1", "Daily walking reduced blood pressure by 8% over 12 weeks"), ("c2", "Volcanoes erupted in Iceland")], "claim_id string, claim string")
    v = verify.verify(claims, docs)
    got = {r["claim_id"]: r for r in v.claims.collect()}
    assert (got["c1"]["verdict"], got["c1"]["source_count"], got["c1"]["ics"]) == ("SUPPORTED", 2, 1)
    assert got["c2"]["verdict"] == "UNVERIFIED"


def test_store(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store")
    kind = "id string, text string, verdict string, confidence double, ics int, now long"
    s.put_claims(spark.createDataFrame([("a", "Water boils", "PARTIAL", 0.4, 1, 100)], kind))
    s.put_claims(spark.createDataFrame([("b", "water  BOILS!", "SUPPORTED", 0.9, 2, 200), ("a", "Water boils", "SUPPORTED", 0.8, 2, 300)], kind))
    rows = {r["id"]: r for r in s.find("claims").collect()}
    assert rows["a"]["verdict"] == "SUPPORTED" and rows["b"]["first_seen"] == 100
    assert s.stats()["claims"] == 2 and s.stats()["docs"] == 0 and s.find("claims", id=None).count() == 0
    assert [r["reason"] for r in s.recall(spark.createDataFrame([("WATER boils",)], "text string"), 400).collect()] == ["hit"]
    with pytest.raises(ValueError, match="Unknown table"):
        s.table("nothing")


KIND = "id string, text string, verdict string, confidence double, ics int, now long"


def test_no_claim_is_lost_to_case(spark, tmp_path):
    """Letters whose capitals are not one letter of their own, upper-cased by the caller within the same plan."""
    s = Store(spark, f"file://{tmp_path}/store")
    texts = ["Die Straße ist lang", "DIE STRASSE IST LANG", "GROẞE Worte", "İstanbul is large", "ǰ and ŉ", "!!!"]
    rows = spark.createDataFrame([(str(i), t, None, None, None, 10 + i) for i, t in enumerate(texts)], KIND)
    s.put_claims(rows)
    s.put_claims(rows.withColumn("id", F.concat(F.lit("u"), "id")).withColumn("text", F.upper("text")).withColumn("now", F.col("now") + 100))
    got = {r["id"]: r for r in s.table("claims").collect()}
    assert got.keys() == {f"{h}{i}" for h in ("", "u") for i in range(len(texts))}
    assert got["u1"]["normalized"] == got["1"]["normalized"] == got["u0"]["normalized"] == "die strasse ist lang"
    assert got["u0"]["first_seen"] == 11 and got["0"]["normalized"] == "die straße ist lang"
    asked = spark.createDataFrame([(t,) for t in texts], "text string")
    assert {r["reason"] for r in s.recall(asked.select(F.upper("text").alias("text")), 500).collect()} == {"hit"}


def test_store_passes_over_broken_versions(spark, tmp_path):
    path = tmp_path / "store"
    s = Store(spark, f"file://{path}")
    for i in range(5):
        s.put_claims(spark.createDataFrame([(str(i), f"Claim number {i}", None, None, None, i)], KIND))
    versions = sorted((path / "claims").glob("v-*"), key=lambda p: p.stat().st_mtime)
    assert len(versions) == 3  # older ones are removed
    (path / "claims" / "commit-000000000009").write_text("{half of")
    assert s.table("claims").count() == 5
    for f in versions[-1].glob("*.parquet"):
        f.write_bytes(f.read_bytes()[:10])
    assert {r["id"] for r in s.table("claims").collect()} == set("0123")
    s.put_claims(spark.createDataFrame([("x", "A claim after that", None, None, None, 9)], KIND))
    assert {r["id"] for r in s.table("claims").collect()} == {*"0123", "x"}
    for f in (path / "claims").glob("commit-*"):
        f.write_text("no json")
    assert s.table("claims").count() == 0


def test_a_second_writer_starts_again(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store")
    one = lambda i: spark.createDataFrame([(i, f"q{i}", "quick", 0, 0, "done", "{}")], "id string, question string, mode string, started long, finished long, status string, report_json string")
    tries = []

    def change(old):
        if not tries:
            s.put("runs", one("first"))
        tries.append(1)
        return old.unionByName(one("second"))

    s._update("runs", change)
    assert len(tries) == 2 and {r["id"] for r in s.table("runs").collect()} == {"first", "second"}


def test_store_is_copied_forward_once(spark, tmp_path):
    old, new = f"file://{tmp_path}/old", f"file://{tmp_path}/home/.quillstone/evidence"
    Store(spark, old).put_claims(spark.createDataFrame([("a", "Water boils", None, None, None, 1)], KIND))
    assert Store.migrated(spark, old, new).table("claims").count() == 1
    Store(spark, old).put_claims(spark.createDataFrame([("b", "Ice melts", None, None, None, 2)], KIND))
    assert Store.migrated(spark, old, new).table("claims").count() == 1 and Store(spark, old).table("claims").count() == 2
