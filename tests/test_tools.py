from pyspark.sql import functions as F

from quillstone import tools
from quillstone.operators import dates, research
from quillstone.sources.store import Store

TEXT = "The study found that daily walking reduced blood pressure by 8% over 12 weeks. Participants were adults from three cities. No adverse events were recorded in the trial."
NOW = 1_735_689_600_000


def test_what_is_verified_is_recalled(spark, tmp_path):
    docs = spark.createDataFrame([(1, TEXT), (2, "Penguins eat fish from the cold southern sea all winter long.")], "doc_id int, text string")
    graph = tools.Graph(spark, Store(spark, f"file://{tmp_path}/store"))
    out = tools.verify_text("Daily walking reduced blood pressure by 8% over 12 weeks. Volcanoes erupted in Iceland during 1783.", docs, graph=graph, now=NOW)
    assert {r["verdict"] for r in out.claims.collect()} == {"SUPPORTED", "UNVERIFIED"}
    again = tools.Graph(spark, Store(spark, f"file://{tmp_path}/store"))
    found = tools.research_recall("does daily walking reduce blood pressure", again, NOW + 1000).collect()
    assert [r["verdict"] for r in found] == ["SUPPORTED"] and found[0]["fresh"]
    late = NOW + 400 * 86_400_000
    assert tools.research_recall("daily walking blood pressure", again, late).count() == 0
    assert [r["fresh"] for r in tools.research_recall("daily walking blood pressure", again, late, include_stale=True).collect()] == [False]


def test_research_marks_what_is_known_and_keeps_what_is_found(spark):
    docs = spark.createDataFrame([(1, TEXT)], "doc_id int, text string")
    graph = tools.Graph(spark)
    graph.add(spark.createDataFrame([("k", "Daily walking reduced blood pressure by 8% over 12 weeks", "SUPPORTED", 0.9, 2, NOW)], "id string, text string, verdict string, confidence double, ics int, now long"))
    r = tools.deep_research("Daily walking reduced blood pressure by 8% over 12 weeks", docs, mode="quick", graph=graph, now=NOW)
    assert r.questions[0]["prior"]["id"] == "k" and any("known from before" in t for t in r.timeline)
    stored = {x["verdict"] for x in graph.claims.collect()}
    assert stored <= {"SUPPORTED", "PARTIAL"} and graph.claims.count() >= 1


def test_sources(spark):
    pages = spark.createDataFrame([("https://www.sec.gov/2024/03/12/x", f"<p>{TEXT}</p>"), ("https://blog.example/p", None)], "url string, html string")
    got = {r["url"]: r for r in tools.check_source(pages, NOW).collect()}
    assert got["https://www.sec.gov/2024/03/12/x"]["is_primary"] and got["https://www.sec.gov/2024/03/12/x"]["published"] == 1710201600000
    assert got["https://blog.example/p"]["published"] is None
    docs = spark.createDataFrame([("a", TEXT), ("b", TEXT), ("c", "Penguins eat fish from the cold southern sea all winter long.")], "id string, text string")
    total, traced = tools.compare_sources(docs.withColumn("published_at", F.lit(None).cast("long")))
    assert (total.first()["total"], total.first()["ics"]) == (3, 2) and traced.count() == 3


def test_sub_questions():
    assert research.decompose("Compare Postgres versus MySQL compared to Oracle for small teams") == ["Compare Postgres versus MySQL compared to Oracle for small teams", "Postgres for small teams", "MySQL for small teams", "Oracle for small teams"]
    assert research.decompose("Was the bridge sound? Who paid for the repairs; when was it closed") == ["Was the bridge sound?", "Who paid for the repairs", "when was it closed"]
    assert len(research.decompose("or what")) == 3 and research.decompose("A or B")[0] == "A or B"


def test_nested_json_ld_and_attributes(spark):
    html = """<script data-x="1" type='application/ld+json'>[{"@graph":[{"@graph":[{"datePublished":"2020-01-02"}]},{"dateModified":"2021-01-01"}]}]</script>
<script type="text/javascript">application/ld+json {"datePublished":"1999-01-01"}</script><META CONTENT='x "y"' itemprop="PubDate"><meta name=nothing>"""
    r = spark.createDataFrame([(html,), (None,), ("",)], "html string").select(dates.json_ld_dates(F.coalesce("html", F.lit(""))).alias("n"), dates.meta_content(dates.meta_elements(F.coalesce("html", F.lit(""))), "pubdate").alias("m")).collect()
    assert [tuple(x) for x in r[0]["n"] if any(x)] == [("2020-01-02", None), (None, "2021-01-01")] and r[0]["m"] == 'x "y"'
    assert r[1]["n"] == r[2]["n"] == [] and r[1]["m"] is None
