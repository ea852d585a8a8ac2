"""The ten operators against brute force, round trips or held-out rows, and on odd tables."""

import bisect
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillstone.llm import _text, decontaminate, minhash, mixing, ngram, pii, quality, queries, token_counts, toxicity, transport, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, label int, score double"
SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^ \t\n\x0b\f\r]+")


def table(spark, texts):
    return spark.createDataFrame([(i, t, "en", "abc"[(i or 0) % 3] if (i or 0) % 7 else None, 0, "clash", 9, 0.5) for i, t in texts], SCHEMA)


ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "same words here"), (5, "same words here"), (6, "same words here"), (7, "x" * 200_000), (8, "word " * 30_000), (9, "é \U0001f600 \x01 a@b.co +1 202 555 0188")]


def numbers(texts):
    return [(i, t) for i, t in enumerate(texts)]


def test_word_kernels():
    h, first = _text.words(pa.array(["A b\x0bA", None, "", "a"]))
    assert first.tolist() == [0, 3, 3, 3, 4] and h[0] == h[2] == h[3] != h[1]


def near(texts, k, bar):
    sets = {}
    for i, t in texts:
        w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in WORD.findall(t or "")]
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    root = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= bar * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                for i in root:
                    if root[i] in (x, y):
                        root[i] = min(x, y)
    return {i: (len(sets[i]), root[i]) for i in sets}


def variants():
    rng = random.Random(4)
    out, base = [], [rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randrange(1, 9) for _ in range(120)]
    for _ in range(90):  # a family around the threshold: many pairs just below it
        w = list(base)
        for _ in range(rng.randrange(0, 14)):
            w[rng.randrange(len(w))] = str(rng.randrange(10**6))
        out.append(" ".join(w))
    return out + out[:5] + [" ".join(str(rng.randrange(10**6)) for _ in range(40)) for _ in range(20)] + [None, "", "lone", "Lone"]


@pytest.mark.parametrize("chunk, grams", [(512, 2_000_000), (16, 2_000_000), (512, 900)])
def test_minhash_against_brute_force(spark, monkeypatch, chunk, grams):
    monkeypatch.setattr(minhash, "CHUNK", chunk)
    monkeypatch.setattr(minhash, "CHUNK_GRAMS", grams)
    monkeypatch.setattr(minhash, "SMALL", 4)
    texts = numbers(variants())
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(table(spark, texts), k=2).collect()}
    assert got == near(texts, 2, 80)


def test_minhash_tile_compares_exactly():
    rng = np.random.default_rng(1)
    sets = [np.sort(rng.choice(60, rng.integers(1, 50), replace=False)) for _ in range(40)]
    t = pa.table({"id": pa.array(range(40), pa.int64()), "label": pa.array(range(40), pa.int64()), "grams": pa.array([s.tolist() for s in sets], pa.list_(pa.int64()))})
    got = minhash._compare(t, 60, block=7)
    want = {(a, b) for a in range(40) for b in range(a + 1, 40) if 100 * len({*sets[a]} & {*sets[b]}) >= 60 * len({*sets[a]} | {*sets[b]})}
    assert set(zip(got["a"].to_pylist(), got["b"].to_pylist())) == want


def test_elias_fano():
    rng = np.random.default_rng(2)
    for most in (3, 1000, 10**12):
        values = np.unique(rng.integers(0, most, 70_000))
        e = ngram.EliasFano(*ngram.EliasFano.encode(values))
        assert (e.all() == values).all()
        asked = np.concatenate([values[::7], rng.integers(0, most, 100)])
        want = [i if i < len(values) and values[i] == x else -1 for x in asked for i in [bisect.bisect_left(values, x)]]
        assert e.find(asked).tolist() == want


def test_ngram_scores(spark):
    rng = random.Random(1)
    texts = numbers([" ".join(w for _ in range(40) for w in (("New", "york", "city") if rng.random() < 0.5 else (rng.choice(["a", "b", "c"]),))) for _ in range(60)] + [None, "", "unseen"])
    rows = {r["doc_id"]: r for r in ngram.language_model_scores(table(spark, texts), F.col("doc_id") % 5 != 1).collect()}
    counts = {}
    for i, t in texts:
        if i % 5 != 1:
            for w in [x.lower() for x in WORD.findall(t or "")] + [None]:
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    for i, t in texts:
        w = [x.lower() for x in WORD.findall(t or "")] + [None]
        base = sum(np.log10((counts.get(x, 0) + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        r = rows[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(x in counts for x in w), n)
        assert abs(r["base_score"] - base) < 1e-6
    assert sum(r["score"] for r in rows.values() if not r["train"]) > sum(r["base_score"] for r in rows.values() if not r["train"])


def trigram_scores(texts, trained, mu=(1000.0, 30.0)):
    """log10 scores of all texts, from counts of every word's n-grams."""
    from collections import Counter

    uni, bi, tri, one, two = (Counter() for _ in range(5))
    lines = {i: ["<", "<", *(x.lower() for x in WORD.findall(t or "")), ">"] for i, t in texts}
    grams = {i: list(zip(w, w[1:], w[2:])) for i, w in lines.items()}
    for i in filter(trained, grams):
        for a, b, c in grams[i]:
            uni[c] += 1
            bi[b, c] += 1
            tri[a, b, c] += 1
            one[b] += 1
            two[a, b] += 1
    n, v = sum(uni.values()), len(uni)

    def p(a, b, c):
        p1 = (uni[c] + 0.5) / (n + 0.5 * (v + 1))
        p2 = (bi[b, c] + mu[0] * p1) / (one[b] + mu[0])
        return (tri[a, b, c] + mu[1] * p2) / (two[a, b] + mu[1])

    return {i: (len(g), sum(np.log10(p(*x)) for x in g)) for i, g in grams.items()}


@pytest.mark.parametrize("frequent", [None, 3, 0])
def test_ngram_scores_of_more_words_than_are_broadcast(spark, monkeypatch, frequent):
    if frequent is not None:
        monkeypatch.setattr(ngram, "FREQUENT", frequent)
    rng, many = random.Random(5), 90_000 if frequent is None else 600
    lines = [" ".join(f"w{j}" for j in range(i, min(i + 60, many))) for i in range(0, many, 60)]
    texts = numbers(lines * 3 + [" ".join(rng.choice(["a", "b", f"w{rng.randrange(many)}", f"new{rng.randrange(9)}"]) for _ in range(50)) for _ in range(200)] + [None, "w1"])
    want = trigram_scores(texts, lambda i: i % 5 != 1)
    got = {r["doc_id"]: (r["n_tokens"], r["score"]) for r in ngram.language_model_scores(table(spark, texts), F.col("doc_id") % 5 != 1).collect()}
    assert got.keys() == want.keys()
    for i, (n, score) in want.items():
        # probabilities are quantised in steps of 1/4096, two for a token
        assert got[i][0] == n and abs(got[i][1] - score) < n / 4096 + 1e-3


def test_toxicity_on_held_out_rows(spark):
    """On sf0.1: sf0.01 has 14 toxic rows held out, and about 40 to learn from, too few for the dictionaries (AUC 0.71 there)."""
    path = "/root/testdata/sf0.1"
    got = queries.op3_toxicity(spark, path).join(spark.read.parquet(f"{path}/labels.parquet"), "doc_id").filter("held_out").collect()
    bad, good = [r["score"] for r in got if r["toxic"]], [r["score"] for r in got if not r["toxic"]]
    assert np.mean([(x > y) + 0.5 * (x == y) for x in bad for y in good]) > 0.85
    assert all(r["predicted"] == (r["score"] >= 0.3) for r in got)


def _two_languages(n, seed):
    """(text, toxic, language) of two invented languages, the second a tenth of the texts, its insults stems of ordinary syllables."""
    r = random.Random(seed)
    syllables = [[r.choice(a) + r.choice(b) + r.choice(c) for _ in range(40)] for a, b, c in (("bdfgklm", "aei", ["", "n", "r"]), ("prstvz", "ou", ["", "l", "x"]))]
    insults = [["idiot", "moron", "scum", "trash", "clown"], ["".join(syllables[1][:3]), "".join(syllables[1][3:6])]]
    for _ in range(n):
        k, toxic = int(r.random() < 0.1), int(r.random() < 0.5)
        words = ["".join(r.choice(syllables[k]) for _ in range(r.randint(1, 4))) for _ in range(r.randint(40, 80))]
        for _ in range(2 * toxic):
            x = r.choice(insults[k])
            words[r.randrange(len(words))] = x + (r.choice(syllables[1]) if k else "")
        yield " ".join(words), toxic, k


def test_toxicity_keeps_the_rarer_language():
    rows = list(_two_languages(3500, 4))
    model = toxicity.fit_toxicity([(text, toxic) for text, toxic, _ in rows[:2000]])
    for k in (0, 1):
        bad, good = ([model.score(text) for text, toxic, lang in rows[2000:] if lang == k and toxic == label] for label in (1, 0))
        assert np.mean([(x > y) + 0.5 * (x == y) for x in bad for y in good]) > 0.8, k


def test_mixing(spark):
    rows = queries.op4_mixing(spark, SF).collect()
    taken, target, size = {}, {}, 0
    for r, d in zip(sorted(rows, key=lambda r: r["doc_id"]), sorted(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect())):
        assert r["size"] == len(WORD.findall(d["text"] or "")) and r["taken"] <= 2 * r["size"]
        taken[d["source"]], target[d["source"]] = taken.get(d["source"], 0) + r["taken"], r["target"]
        size += r["size"]
    for s in taken:
        assert abs(taken[s] - target[s]) <= 1
    again = {r["doc_id"]: r["taken"] for r in queries.op4_mixing(spark, SF).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in rows}


def test_shards_hold_their_share_of_every_source(spark, tmp_path):
    rng = random.Random(3)
    texts = [(None if i % 40 == 0 else i // 2, " ".join(f"w{i}x{j}" for j in range(rng.randrange(1, 90)))) for i in range(400)] + [(9, "\t" + " ".join(f"long{j}" for j in range(4000))), (11, None), (12, " ")]
    docs = spark.createDataFrame([(i, t, ("abc"[k % 3] if k % 11 else None)) for k, (i, t) in enumerate(texts)], "doc_id long, text string, source string")
    how = dict(block=16, shards=8)
    mixed = mixing.mix(docs, **how)
    plan = mixed.select("source_size", "target", "passes").distinct().collect()
    assert max(r["passes"] for r in plan) == 2 and len(plan) == 4
    mixing.write_shards(docs, str(tmp_path / "s"), **how)
    source = {w: d["source"] for d in docs.collect() for w in (d["text"] or "").split()}
    blocks, words, drawn = {}, {}, {}
    for r in spark.read.parquet(str(tmp_path / "s")).collect():
        w = r["text"].split(" ")
        s = source[w[0]]
        blocks.setdefault(r["shard"], {}).setdefault(s, set()).add(r["order"])
        words[s] = words.get(s, 0) + len(w)
        for x in w:
            drawn[x] = drawn.get(x, 0) + 1
    assert sorted(words.values()) == sorted(round(r["target"]) for r in plan)
    size = {s: sum(x == s for x in source.values()) for s in words}
    of = {r["source_size"]: r for r in plan}
    whole = {s: of[size[s]]["passes"] for s in words}
    assert all(whole[s] <= drawn.get(w, 0) <= whole[s] + 1 for w, s in source.items())
    # the quotas of all passes, as the tree splits them
    names = sorted(words, key=lambda s: (s is None, s or ""))
    quota = []
    for s in names:
        n, t = size[s], round(of[size[s]]["target"])
        quota.append(t // n * -(-n // 16) + -(-(t - t // n * n) // 16))
    leaves = mixing.split(np.array(quota), 8, np.random.Generator(np.random.PCG64(17)))
    assert [[len(blocks[k].get(s, ())) for s in names] for k in range(8)] == leaves.tolist()


def test_splitting_tree_keeps_quotas():
    quotas = np.array([1000, 37, 0, 512])
    leaves = mixing.split(quotas, 13, np.random.default_rng(0))
    assert (leaves.sum(axis=0) == quotas).all() and leaves.sum(axis=1).max() - leaves.sum(axis=1).min() <= 1 and leaves.min() >= 0


def test_permutation_is_one():
    for n in (1, 2, 7, 1000):
        assert sorted(mixing.permuted(np.arange(n), np.full(n, n), np.full(n, 9, np.uint64)).tolist()) == list(range(n))


@pytest.mark.parametrize("size", [576, 2304, 2304 * 5 + 1, 100_000])
def test_transport_round_trip(size):
    payload = np.random.default_rng(size).integers(0, 256, size, dtype=np.uint8).tobytes()
    s = transport.read_ts(transport.write_ts(payload))
    assert s.payload == payload and s.errors == s.discontinuities == 0 and s.access[0] == 0 and s.times == sorted(s.times)


def test_transport_counts_lost_packets():
    media = transport.write_ts(bytes(10_000))
    cut = media[: 188 * 6] + media[188 * 7 :]
    s = transport.read_ts(cut)
    assert s.discontinuities == 1 and s.errors >= 1 and len(s.payload) < 10_000


def test_warc_round_trip(spark):
    pages = [(1, "u1", "a" * 200), (2, "u2", "a" * 200), (3, None, None), (4, "u4", "short"), (5, "u\r\n5%", "short"), (6, "u6", "é\r\n\r\nWARC/1.1\r\n" * 30), (2, "u2", "a" * 200)]
    got = warc.round_trip(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert sorted((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in got if r["page_id"] != 2) == [(1, 200, "response", None), (3, 0, "response", None), (4, 5, "response", None), (5, 5, "response", None), (6, len(pages[5][2].encode()), "response", None)]
    assert [(r["record_type"], r["refers_to"]) for r in got if r["page_id"] == 2] == [("revisit", 1)] * 2


def test_warc_pushes_filters(spark, tmp_path):
    warc.archive(spark.createDataFrame([(i, f"u{i}", "x" * 500) for i in range(4)], "page_id long, url string, html string"), str(tmp_path / "w"))
    r = spark.read.format("warc").option("path", str(tmp_path / "w")).load()
    assert r.filter("record_type = 'revisit'").count() == 3 and r.filter("target_uri = 'u2'").select("record_id").collect()[0][0] == "2"


def base_spans(text):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for kind, p in patterns.items():
        for m in re.finditer(p, text or "", re.A):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0 if d else False
            if {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else False, "card": 13 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_pii_against_brute_force(spark):
    rng = random.Random(8)
    pieces = ["4111 1111 1111 1111", "4111-1111-1111-1112", "10.0.0.256", "1.2.3.4.5.6.7.8", "x@y.zz", "a@b.c@d.ee", "+1 (202) 555-0188", "+1", "1234567890123456789012", "é", "\U0001f600", "%a@b-.c", "--", " ", ". ", "9"]
    texts = numbers(["".join(rng.choice(pieces) for _ in range(rng.randrange(0, 14))) for _ in range(150)] + [None, "", "a@b.cc " * 5000])
    import hashlib

    for r in pii.personal_data(table(spark, texts)).collect():
        want = base_spans(dict(texts)[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), (dict(texts)[r["doc_id"]], r["spans"])
        assert set(want) <= set(r["spans"].split(",")) | {""}


def test_redaction(spark):
    out = pii.redact(table(spark, [(1, "mail x@y.zz now"), (2, None), (3, "nothing")])).select("doc_id", "text").collect()
    assert dict(map(tuple, out)) == {1: "mail <EMAIL> now", 2: None, 3: "nothing"}


def test_token_counts_against_the_library(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    t = Tokenizer.from_file(path)
    texts = numbers(["", None, "Hello  world's\n\n12 three　four​ \U0001f600", "<|endoftext|>a<|endoftext|>", "\x85 \x1c\xa0x", "don't I'LL", "a " * 1100]) + [(100 + r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: r for r in token_counts.token_counts(table(spark, texts), path).collect()}
    for i, x in texts:
        n = len(t.encode(x or "", add_special_tokens=False).ids)
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (n, len((x or "").encode()), n > 1024)


def test_tiling_covers_reordered_passages(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    w = item.split()
    texts = [(1, item), (2, " ".join(w[10:] + ["noise"] + w[:10])), (3, " ".join(w[:9])), (4, " ".join(reversed(w))), (5, None), (6, "PREFIX, " + item.upper() + "!")]
    got = decontaminate.contamination(table(spark, texts), spark.createDataFrame([(7, item), (8, "too short"), (9, None)], "item_id long, text string")).collect()
    assert {r["doc_id"]: round(r["coverage"], 2) for r in got} == {1: 1.0, 2: 1.0, 6: 1.0}
    low = decontaminate.contamination(table(spark, texts), spark.createDataFrame([(7, item)], "item_id long, text string"), threshold=0.4, block_chars=10).collect()
    assert {r["doc_id"] for r in low} == {1, 2, 3, 6}


def test_quality(spark):
    good = "The committee has published its report on the state of the river, and the findings are clear. "
    texts = numbers([good * (1 + i % 3) if i % 2 else "$$$ 111 click click click !!! " * 9 for i in range(80)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    got = quality.quality(table(spark, texts), labels, F.col("source"), F.col("lang")).collect()
    assert len(got) == 80 and all((r["score"] > 0.5) == bool(r["doc_id"] % 2) for r in got if r["doc_id"] >= 60)


LABELS = "doc_id long, toxic int, quality int"
RUN = {
    "minhash": lambda d, s: minhash.near_duplicates(d),
    "ngram": lambda d, s: ngram.language_model_scores(d, F.col("doc_id") % 2 == 0),
    "toxicity": lambda d, s: toxicity.toxicity(d, s.createDataFrame([(4, 1, 0), (5, 0, 1), (None, 1, 1), (6, None, None)], LABELS)),
    "mixing": lambda d, s: mixing.mix(d),
    "transport": lambda d, s: transport.media_column(d, keep_media=False),
    "quality": lambda d, s: quality.quality(d, s.createDataFrame([(4, 1, 0), (5, 0, 1)], LABELS), F.col("source"), F.col("lang")),
    "pii": lambda d, s: pii.personal_data(d),
    "token_counts": lambda d, s: token_counts.token_counts(d, queries.tokenizer_path()),
    "decontaminate": lambda d, s: decontaminate.contamination(d, s.createDataFrame([(1, "same words here")], "item_id long, text string"), seed=3),
}


@pytest.mark.parametrize("name", RUN)
def test_odd_and_empty_tables(spark, name):
    rows = RUN[name](table(spark, ODD), spark).collect()
    assert len(rows) == {"minhash": 9, "decontaminate": 3}.get(name, len(ODD))
    assert RUN[name](table(spark, [(None, None), (None, "some text")]), spark).count() == {"minhash": 0, "decontaminate": 0}.get(name, 2)
    assert RUN[name](spark.createDataFrame([], SCHEMA), spark).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, SF)
        assert out.columns == docs.columns, name
        kept = spark.createDataFrame(out.collect(), docs.schema)
        assert 0.5 * docs.count() < kept.count() <= docs.count()
    last = corpus_pipeline.STAGES[-1][1](spark, kept, SF)
    assert last.count() == kept.count()
