from pyspark.sql import functions as F

from quillstone.functions import text as T


def value(spark, text, f):
    return spark.createDataFrame([(text,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


def test_shingles(spark):
    of = lambda t, k: value(spark, t, lambda c: T.shingles(T.words(T.normalize_for_compare(c)), k))
    assert len(of("the quick brown fox jumps", 3)) == 3
    assert of("a b a b a b", 2) == ["a b", "b a"]
    assert of("", 3) == [] and of("hello world", 5) == ["hello world"]


def test_urls(spark):
    assert value(spark, "https://www.Example.com/path/?utm_source=x&id=7#frag", T.normalize_url) == "example.com/path?id=7"
    assert value(spark, "not a url", T.host_of) == ""


def test_entities(spark):
    found = value(spark, "Acme Corporation reported that NASA spent 42 percent more in 2024. However the result held.", T.entities)
    assert found == ["Acme Corporation", "NASA", "42 percent", "2024"]


def test_entities_of_a_long_run(spark):
    run = "Retionly " * 20_000 + "and the Titionly."
    assert value(spark, f"so {run} so", T.entities) == [("Retionly " * 20_000).strip(), "Titionly"]
    assert value(spark, f"so {run.replace('the ', '')} so", T.entities) == ["Retionly " * 20_000 + "and Titionly"]


def test_figures(spark):
    assert value(spark, "reduced by 8% over 12 weeks, 1,200 and 8.0, not 3.1.4", T.figures) == [8.0, 12.0, 1200.0]


def test_sentences_are_joined_until_long_enough(spark):
    assert value(spark, "Short. Also A. This one is certainly long enough to stand alone here. Tail.", T.quotable) == ["Short. Also A. This one is certainly long enough to stand alone here."]
    assert value(spark, "Tiny.", T.quotable) == ["Tiny."] and value(spark, "", T.quotable) == []


def test_volatility_and_freshness(spark):
    kinds = [value(spark, t, T.volatility) for t in ("The stock price rose", "Ada was born in 1815", "See RFC 9110", "Plants grow")]
    assert kinds == ["fast", "immutable", "immutable", "slow"]
    hour, now = 3_600_000, 10**13
    rows = [(now - 2 * hour, "fast", True), (now - 30 * hour, "fast", False), (now - 30 * 24 * hour, "slow", True), (now - 400 * 24 * hour, "slow", False), (0, "slow", False), (None, "slow", False)]
    df = spark.createDataFrame(rows, "t long, k string, want boolean")
    assert df.filter(T.is_fresh(F.col("t"), F.col("k"), F.lit(now)) != F.col("want")).count() == 0


def test_html(spark):
    html = "<nav>menu</nav><p>One&amp;lt;two</p><script>x</script>a<br/>b   c<!-- gone -->"
    assert value(spark, html, T.strip_html) == "One<two\n a\nb c"


def test_dedupe_strings(spark):
    df = spark.createDataFrame([(["A", " a ", "", "b"],)], "x array<string>")
    assert df.select(T.dedupe_strings(F.col("x"))).first()[0] == ["A", "b"]
