"""Contract columns against SQL, and what SQL can't say against brute force."""

import gzip
import math
import os
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.llm import decontaminate, mixing, quality, queries, token_counts, transport, warc

from .test_operators import ODD, SCHEMA, base_spans, near, numbers, table

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["mixing_targets", "transport_payloads", "personal_data_counts", "token_bytes", "op1_minhash_near_dedup", "op6_warc"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    want = con.sql(queries.SQL[name])
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    plain = lambda rows: sorted(repr([round(x, 6) if isinstance(x, float) else x for x in r]) for r in rows)
    assert plain(map(tuple, got.select(*want.columns).collect())) == plain(want.fetchall())


def words(text):
    return [w.lower() for w in re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", text or "")]


def greedy(text, item, seed):
    """The share of the item's words that greedy tiling marks, by definition."""
    t, w = words(text), words(item)
    seed = min(seed, len(w))
    used_t, used_w = set(), set()
    while seed:
        best = (0, 0, 0)
        for j in range(len(w)):
            for i in range(len(t)):
                n = 0
                while j + n < len(w) and i + n < len(t) and w[j + n] == t[i + n] and j + n not in used_w and i + n not in used_t:
                    n += 1
                best = max(best, (n, -j, -i))
        n, j, i = best[0], -best[1], -best[2]
        if n < seed:
            break
        used_w |= set(range(j, j + n))
        used_t |= set(range(i, i + n))
    return len(used_w) / len(w) if w else 0.0


def test_tiling_against_brute_force(spark):
    rng = random.Random(6)
    draw = lambda n: " ".join(rng.choice("abcd") if rng.random() < 0.5 else rng.choice(["north", "south", "east"]) for _ in range(n))
    items = [(i, draw(rng.randrange(0, 16))) for i in range(12)] + [(12, "one two"), (12, "one two"), (13, None), (14, "single")]
    texts = numbers([" ".join(rng.choice([items[k][1] or "", draw(4)]) for k in rng.sample(range(14), 3)) for _ in range(25)] + [None, "", "ONE, two!", "a single word"])
    got = {}
    for r in decontaminate.contamination(table(spark, texts), spark.createDataFrame(items, "item_id long, text string"), seed=3, threshold=0.6).collect():
        got.setdefault((r["doc_id"], r["item_id"]), []).append(round(r["coverage"], 9))
    want = {}
    for d, t in texts:
        for i, w in items:
            if words(w) and (c := greedy(t, w, 3)) >= 0.6:
                want.setdefault((d, i), []).append(round(c, 9))
    assert got == want and (27, 12) in got and (28, 14) in got


def test_posteriors_leave_the_row_out(spark):
    rng = random.Random(2)
    rows = [("h%d" % (i % 3) if i % 7 else None, "p%d" % (i % 5), rng.random(), rng.random()) for i in range(60)] + [("alone", "x", 0.5, 1.0)]
    scored = spark.createDataFrame(rows, "host string, path string, p double, e double")
    sites, a, b = quality.posteriors(scored, 0.4)
    joined = scored.alias("d").join(sites.alias("s"), F.col("d.host").eqNullSafe(F.col("s.host")) & F.col("d.path").eqNullSafe(F.col("s.path")))
    got = sorted(round(r["x"], 9) for r in joined.select(quality.left_out(0.4, a, b).alias("x")).collect())
    want = []
    for i, (h, p, _, _) in enumerate(rows):
        host = [e for j, (x, _, _, e) in enumerate(rows) if x == h and j != i]
        path = [e for j, (x, y, _, e) in enumerate(rows) if x == h and y == p and j != i]
        rate = (sum(host) + a * 0.4) / (len(host) + a)
        want.append(round((sum(path) + b * rate) / (len(path) + b), 9))
    assert got == sorted(want) and 0.4 in want  # a row alone on its host has the global prior


def test_hosts_and_paths_of_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", F.col("html").alias("text"))
    labels = pages.select("page_id", (F.col("page_id") % 2).cast("int").alias("quality"))
    host, path = F.regexp_extract("url", "://([^/]*)", 1), F.regexp_extract("url", "://[^/]*(/[^/]*)", 1)
    got = quality.quality(pages, labels, host, path, id_col="page_id").collect()
    assert len(got) == pages.count() and all(0 <= r["score"] <= 1 and 0 < r["site_prior"] < 1 for r in got)


def test_draws_beyond_a_billion_blocks():
    rng = np.random.default_rng(4)
    quotas = np.array([6 * 10**9, 3 * 10**9, 0, 7])
    leaves = mixing.split(quotas, 16, rng)
    assert (leaves.sum(axis=0) == quotas).all() and leaves.min() >= 0 and np.ptp(leaves.sum(axis=1)) <= 1
    good, bad, n = 2 * 10**9, 10**9, 3 * 10**5
    draws = np.array([mixing.hypergeometric(good, bad, n, rng) for _ in range(3000)])
    sd = math.sqrt(n * 2 / 9)
    assert abs(draws.mean() - n * 2 / 3) < 5 * sd / math.sqrt(3000) and abs(draws.std() / sd - 1) < 0.06


def test_stored_streams_hold_the_payload(spark):
    texts = numbers(["a", None, "é" * 5000])
    for r in transport.media_column(table(spark, texts)).collect():
        s = transport.read_ts(bytes(r["media"]))
        assert s.payload == transport.padded(dict(texts)[r["doc_id"]])[0] and list(r["times"]) == s.times and list(r["access"]) == s.access


def test_tokenizers_of_other_kinds(spark, tmp_path):
    """Files that normalize, or cut by other rules, are counted by the library."""
    from tokenizers import Tokenizer, normalizers, pre_tokenizers

    texts = numbers(["Hello World  it's", "ÀÉ x", "", None, "a-b c"])
    for i, change in enumerate((lambda t: setattr(t, "normalizer", normalizers.Lowercase()), lambda t: setattr(t, "pre_tokenizer", pre_tokenizers.ByteLevel(add_prefix_space=True)), lambda t: t.enable_truncation(2))):
        t = Tokenizer.from_file(queries.tokenizer_path())
        change(t)
        t.save(str(tmp_path / f"{i}.json"))
        t.no_truncation()
        got = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(table(spark, texts), str(tmp_path / f"{i}.json")).collect()}
        assert got == {k: len(t.encode(x or "", add_special_tokens=False).ids) for k, x in texts}


def test_archives_of_others(spark, tmp_path):
    digest = "2d711642b726b04401627ca9fbac32f5c8530fb1903cc4db02258717921a4881"
    one = lambda uri, digest: f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:1>\r\nWARC-Target-URI: {uri}\r\nWARC-Payload-Digest: {digest}\r\nContent-Length: 1\r\n\r\nx\r\n\r\n".encode()
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "a.warc").write_bytes(one("http://h/a%20b?q=%2F", f"sha256:{digest}") + one("http://h/100%zz", "sha1:ABC"))
    (tmp_path / "w" / "b.warc.gz").write_bytes(gzip.compress(one("http://h/%FF", digest)) + gzip.compress(one("z", digest)))
    warc.register(spark)
    r = spark.read.format("warc").option("path", str(tmp_path / "w")).load()
    assert {x["target_uri"] for x in r.collect()} == {"http://h/a%20b?q=%2F", "http://h/100%zz", "http://h/%FF", "z"}
    assert r.filter("target_uri = 'z'").count() == 1
    assert {(x["page_id"], x["payload_digest"]) for x in warc.archived(spark, str(tmp_path / "w")).collect()} == {(None, digest)}
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "a.warc").write_bytes(one("u", "0" * 64))
    with pytest.raises(Exception, match="another digest"):
        warc.archived(spark, str(tmp_path / "bad")).collect()


def test_archives_of_odd_tables(spark):
    pages = spark.createDataFrame([(None, None, None, 1), (1, "u", "", 2), (1, "u", "", 2), (2, "%", "é" * 2_000_000, 3), (3, "v", "é" * 2_000_000, 3)], "page_id long, url string, html string, payload int")
    got = sorted((r["page_id"] or 0, r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.round_trip(pages).collect())
    assert got == [(0, 0, "response", None), (1, 0, "response", None), (1, 0, "response", None), (2, 4_000_000, "response", None), (3, 4_000_000, "revisit", 2)]
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_pipeline_against_brute_force(spark, tmp_path):
    """All stages but the learnt first one, each judged on what it was given."""
    import corpus_pipeline

    rng = random.Random(9)
    say = lambda n: " ".join(rng.choice("abcdefghij") * rng.randrange(1, 6) for _ in range(n))
    body, item = say(60), say(20)
    texts = [body, body, body + " more", body.replace(" ", "  "), say(50), item + " " + say(30), say(10) + " " + " ".join(item.split()[:9]), "mail x@y.zz and 4111 1111 1111 1111", None, "", "lone", "Lone"]
    rows = [(None if i == 4 else min(i, 9), t, "en", "ab"[i % 2], 0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = sorted((r["text"] for r in stages["near_dedup"](spark, docs, str(tmp_path)).collect()), key=str)
    groups = near(numbers(texts), 5, 80)
    assert len(kept) == len({root for _, root in groups.values()}) and sum(t is None for t in kept) == 1 and sum((t or "").startswith(body[:20]) for t in kept) == 1
    clean = [r["text"] for r in stages["decontamination"](spark, docs, str(tmp_path)).collect()]
    assert sorted(clean, key=str) == sorted((t for t in texts if greedy(t, item, 5) < 0.5), key=str) and len(clean) == len(texts) - 1
    redacted = {r["text"]: r["n_chars"] for r in stages["pii"](spark, docs, str(tmp_path)).collect()}
    assert all(n == (None if t is None else len(t)) for t, n in redacted.items()) and not any(base_spans(t) for t in redacted)
    mixed = stages["mixing"](spark, docs, str(tmp_path)).collect()
    assert len(mixed) == len(texts) and sum(r["taken"] for r in mixed) == round(1.5 * sum(r["size"] for r in mixed))


def test_pipeline_on_odd_tables(spark):
    import corpus_pipeline

    for rows in (ODD, [(None, None), (None, "some text")], []):
        docs = table(spark, rows) if rows else spark.createDataFrame([], SCHEMA)
        docs = docs.withColumn("row", F.lit("r"))
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            if name != "mixing":
                assert out.columns == docs.columns, name
                docs = spark.createDataFrame(out.collect(), docs.schema)
            else:
                assert out.count() == docs.count()
