"""Personal data by weak supervision, in DataFrame functions only.

Candidates are matches of the base patterns and of looser ones. Three labelers vote on each (1 for, -1 against, 0 abstains): a regex
labeler checks form and checksums, a gazetteer labeler known domains, prefixes and ranges, a context labeler the words before it.
Expectation-maximisation estimates, for each kind, how reliable each labeler is, from the counts of vote patterns; a naive Bayes
span classifier is then trained on the posteriors over the candidates' features. Base spans always stay; a looser candidate is added
when the classifier gives it one half or more and it overlaps no base span of its kind.

Only counts by kind, votes and features reach the driver: at most 4 * 27 * 84 rows, whatever the corpus.
"""

from __future__ import annotations

import math
from collections import defaultdict
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: The contract's patterns, with possessive loops and fixed starts in place of retries that cannot succeed: same matches, linear time.
_NAME = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:\G|(?<!{_NAME})){_NAME}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?=[0-9])(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?=[0-9])(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
LOOSE = {
    "email": rf"(?<!{_NAME}){_NAME}{{1,64}} ?[(\[]at[)\]] ?[A-Za-z0-9-]{{1,63}}(?: ?(?:[(\[]dot[)\]]|\.) ?[A-Za-z0-9-]{{1,63}}){{1,8}}",
    "phone": r"(?=[0-9(])(?<![0-9.+-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9.-])",
}
# --- fixed values of the gazetteer: generic endings of domains (any two letters are a country's), ends of made-up domains, ranges of
# addresses that are no host's (RFC 6890) or private, prefixes of card issuers, calling codes of countries ---
DOMAINS = (
    "aero", "app", "biz", "blog", "cat", "cloud", "com", "coop", "dev", "edu", "email", "eu", "gov", "info", "int", "jobs", "mil", "mobi",
    "museum", "name", "net", "news", "online", "org", "page", "post", "pro", "shop", "site", "store", "tech", "tel", "travel", "web", "xyz",
)
MADE_UP = r"(?:^|[@.])(?:example\.(?:com|net|org)|test|invalid|localhost|local|example)$"
NO_HOST = r"^(?:0|127|22[4-9]|23[0-9]|24[0-9]|25[0-5]|192\.0\.[02]|198\.51\.100|203\.0\.113|198\.1[89]|169\.254)\."
PRIVATE = r"^(?:10|192\.168|172\.(?:1[6-9]|2[0-9]|3[01])|100\.(?:6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7]))\."
ISSUERS = "4|5[1-5]|222[1-9]|22[3-9]|2[3-6]|27[01]|2720|3[47]|6011|64[4-9]|65|352[89]|35[3-8]|30[0-5]|3[689]|62|50|5[6-9]|6[0-9]"
CALLING = "1|7|2[07]|2[1-69][0-9]|3[0-469]|3[578][0-9]|4[013-9]|42[0-9]|5[1-8]|5[09][0-9]|6[0-6]|6[7-9][0-9]|8[1246]|8[0578][0-9]|9[0-58]|9[679][0-9]"
# --- fixed values of the context: words that stand before personal data, and before numbers that are none (English, German, French, Spanish) ---
WORDS = {
    "email": (r"mail|contact|write|address|reach|send|kontakt|schreib|adresse|courriel|contactez|[eé]crire|correo|escrib|direcci[oó]n", r"example of|regex|pattern|beispiel|exemple|ejemplo"),
    "ip": (r"\bip\b|ipv4|address|host|server|login|logged|from|client|connect|adresse|rechner|serveur|servidor|direcci[oó]n", r"version|release|section|chapter|build|figure|\bv$|fassung|kapitel|chapitre|versi[oó]n|cap[ií]tulo"),
    "card": (r"card|visa|master|amex|credit|debit|payment|account|pay|karte|zahlung|konto|carte|paiement|compte|tarjeta|pago|cuenta", r"isbn|order|serial|\bid\b|token|=|invoice|tracking|bestell|rechnung|commande|facture|pedido|factura"),
    "phone": (r"phone|call|tel|fax|mobile|contact|cell|dial|sms|text|whatsapp|ruf|handy|anruf|appel|portable|llam|m[oó]vil", r"isbn|order|serial|version|invoice|bestell|rechnung|commande|facture|pedido|factura"),
}
_MARK, _RUN = "\u0001", 256


#: What a text must hold for a pattern to match at all; found at a fraction of the pattern's cost.
_NEEDS = {"email": ("@",), "phone": ("+",), "email~": ("at)", "at]")}


def with_matches(df: DataFrame, text: str, name: str, pattern: str) -> DataFrame:
    """Adds array ``name`` of (start, end, found, before) of the leftmost non-overlapping matches in column ``text``, which must not
    hold the mark itself; offsets in code points, end exclusive. Null where there is none.

    Matches are marked, the text is split at the marks, and lengths are summed: within runs of pieces first, then over the runs, so
    that a text of very many matches stays cheap. Each step is a column of its own, so that none is computed twice.
    """
    t, kind = F.col(text), "array<struct<start:bigint,end:bigint,found:string,before:string>>"
    need = _NEEDS.get(name[2:])
    able = reduce(Column.__or__, (F.contains(t, F.lit(x)) for x in need)) if need else F.col("__digits")
    has = able & F.rlike(t, F.lit(pattern))

    def step(acc: Column, piece: Column) -> Column:
        end = acc["pos"] + F.length(piece)
        one = F.array(F.struct(acc["pos"].alias("start"), end.alias("end"), piece.alias("found"), F.right(acc["last"], F.lit(40)).alias("before")))
        return F.struct((acc["i"] + 1).alias("i"), end.alias("pos"), piece.alias("last"), F.when(acc["i"] % 2 == 1, F.concat(acc["out"], one.cast(kind))).otherwise(acc["out"]).alias("out"))

    def within(start: Column, run: Column) -> Column:
        zero = F.struct(F.lit(0).alias("i"), start.alias("pos"), F.lit("").alias("last"), F.array().cast(kind).alias("out"))
        return F.aggregate(run, zero, step, lambda a: a["out"])

    df = df.withColumn("__pieces", F.when(has, F.split(F.regexp_replace(t, f"({pattern})", f"{_MARK}$1{_MARK}"), _MARK, -1)))
    df = df.withColumn("__runs", F.transform(F.when(F.col("__pieces").isNotNull(), F.sequence(F.lit(0), F.floor((F.size("__pieces") - 1) / _RUN).cast("int"))), lambda r: F.slice("__pieces", r * _RUN + 1, F.lit(_RUN))))
    sizes = F.transform("__runs", lambda run: F.aggregate(run, F.lit(0).cast("bigint"), lambda a, p: a + F.length(p)))
    zero = F.struct(F.lit(0).cast("bigint").alias("pos"), F.array().cast("array<bigint>").alias("out"))
    df = df.withColumn("__begin", F.aggregate(sizes, zero, lambda a, n: F.struct((a["pos"] + n).alias("pos"), F.concat(a["out"], F.array(a["pos"])).alias("out")), lambda a: a["out"]))
    return df.withColumn(name, F.when(F.col("__pieces").isNotNull(), F.flatten(F.zip_with("__begin", "__runs", within)))).drop("__pieces", "__runs", "__begin")


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    back = F.reverse(digits)
    value = lambda i: F.substring(back, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + value(i) - F.when(value(i) > 9, 9).otherwise(0)) % 10 == 0


def _valid(kind: str, found: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(found, r"\."), lambda p: p.cast("double") <= 255)
    if kind == "card":
        return luhn(_digits(found))
    if kind == "phone":
        return F.length(_digits(found)).between(9, 15)
    return F.lit(True)


def _gazetteer(kind: str, x: Column) -> Column:
    found = F.lower(x["found"])
    if kind == "email":
        ending = F.regexp_extract(F.regexp_replace(found, r" ?[(\[](?:dot)[)\]] ?", "."), "([a-z0-9-]+)$", 1)
        known = ending.isin(*DOMAINS) | F.rlike(ending, F.lit("^[a-z]{2}$"))
        return F.when(F.rlike(found, F.lit(MADE_UP)), 0).when(known, 1).otherwise(-1)
    if kind == "ip":
        return F.when(F.rlike(found, F.lit(NO_HOST)), -1).when(F.rlike(found, F.lit(PRIVATE)), 0).otherwise(1)
    if kind == "card":
        return F.when(F.rlike(_digits(found), F.lit(f"^(?:{ISSUERS})")), 1).otherwise(-1)
    return F.when(F.rlike(found, F.lit("^[+]")) & F.rlike(_digits(found), F.lit(f"^(?:{CALLING})")), 1).when(F.rlike(found, F.lit("^[+]")), -1).otherwise(0)


def _context(kind: str, x: Column) -> Column:
    yes, no = WORDS[kind]
    before = F.lower(x["before"])
    return F.when(F.rlike(before, F.lit(yes)), 1).when(F.rlike(before, F.lit(no)), -1).otherwise(0)


def _candidate(kind: str, x: Column, base: Column) -> Column:
    n = F.length(_digits(x["found"]))
    parts = F.size(F.split(x["found"], r"[ ().@\[\]-]+"))
    feature = F.concat_ws("/", F.when(n < 5, "0").when(n < 10, "5").when(n < 13, "10").otherwise("13"), F.least(parts, F.lit(6)).cast("string"), F.when(F.rlike(x["before"], F.lit(r"\s$")), "s").when(x["before"] == "", "b").otherwise("x"))
    regex = F.when(base, 1).otherwise(-1 if kind in ("card", "ip") else 0)
    votes = F.concat_ws(",", *(v.cast("string") for v in (regex, _gazetteer(kind, x), _context(kind, x))))
    return F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), base.alias("base"), votes.alias("votes"), feature.alias("feature"))


def with_candidates(df: DataFrame, text_col: str) -> DataFrame:
    """Adds __found, an array of (kind, start, end, base, votes, feature) by kind, base ones first, then by start."""
    text = F.col(text_col)
    df = df.withColumn("__text", F.when(F.contains(text, F.lit(_MARK)), F.translate(text, _MARK, "\u0002")).otherwise(F.coalesce(text, F.lit(""))))
    df = df.withColumn("__digits", F.rlike("__text", F.lit("[0-9][ .)-]{0,2}[0-9]")))
    patterns = BASE | {f"{k}~": p for k, p in LOOSE.items()}
    for name, pattern in patterns.items():
        df = with_matches(df, "__text", f"__{name}", pattern)
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,base:boolean,votes:string,feature:string>>")
    found = F.concat(*(F.coalesce(x, none) for k in KINDS for x in _of_kind(k)))
    return df.withColumn("__found", found).drop("__text", "__digits", *(f"__{n}" for n in patterns))


def _of_kind(kind: str) -> list[Column]:
    strict = F.transform(f"__{kind}", lambda x: _candidate(kind, x, _valid(kind, x["found"])))
    if kind == "card":  # sequences that fail the checksum stay as candidates
        return [strict]
    strict = F.filter(strict, lambda x: x["base"])
    return [strict, F.transform(F.col(f"`__{kind}~`"), lambda x: _candidate(kind, x, F.lit(False)))] if kind in LOOSE else [strict]


def fit_votes(counts: dict[tuple[int, ...], int], rounds: int = 50) -> tuple[float, list[dict[int, tuple[float, float]]]]:
    """(prior, tables) by expectation-maximisation: tables[l][vote] = P(vote of labeler l | personal), P(vote | not). Starts from
    labelers that are right nine times in ten on what they vote on; a count of one is added to each cell."""
    labelers = len(next(iter(counts), ()))
    prior, tables = 0.5, [{1: (0.6, 0.07), 0: (0.33, 0.33), -1: (0.07, 0.6)} for _ in range(labelers)]
    for _ in range(rounds):
        post = {v: _posterior(v, prior, tables) for v in counts}
        yes = sum(n * post[v] for v, n in counts.items())
        no = sum(n * (1 - post[v]) for v, n in counts.items())
        prior = (yes + 1) / (yes + no + 2)
        tables = [
            {k: ((sum(n * post[v] for v, n in counts.items() if v[i] == k) + 1) / (yes + 3), (sum(n * (1 - post[v]) for v, n in counts.items() if v[i] == k) + 1) / (no + 3)) for k in (1, 0, -1)}
            for i in range(labelers)
        ]
    return prior, tables


def _posterior(votes: tuple[int, ...], prior: float, tables: list) -> float:
    x = math.log(prior / (1 - prior)) + sum(math.log(t[v][0] / t[v][1]) for v, t in zip(votes, tables))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def fit_spans(rows: list[tuple[str, str, str, int]]) -> dict[str, float]:
    """From (kind, votes, feature, count): the span classifier, as the probability of each kind|votes|feature that was seen."""
    model = {}
    for kind in sorted({r[0] for r in rows}):
        own = [(tuple(map(int, v.split(","))), f.split("/"), n, v, f) for k, v, f, n in rows if k == kind]
        counts: dict = defaultdict(int)
        for votes, _, n, _, _ in own:
            counts[votes] += n
        prior, tables = fit_votes(counts)
        post = {v: _posterior(v, prior, tables) for v in counts}
        cells: dict = defaultdict(lambda: [1.0, 1.0])
        total = [1.0, 1.0]
        for votes, parts, n, _, _ in own:
            for y, w in ((0, 1 - post[votes]), (1, post[votes])):
                total[y] += n * w
                for i, part in enumerate(parts):
                    cells[i, part][y] += n * w
        for votes, parts, _, v, f in own:
            x = math.log(max(post[votes], 1e-9) / max(1 - post[votes], 1e-9)) + sum(math.log(cells[i, p][1] / total[1]) - math.log(cells[i, p][0] / total[0]) for i, p in enumerate(parts))
            model[f"{kind}|{v}|{f}"] = 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))
    return model


def fit(df: DataFrame, text_col: str = "text") -> dict[str, float]:
    """The classifier, from the candidates of all rows; counts are combined before they are shuffled."""
    found = with_candidates(df.select(F.col(text_col).alias("text")), "text")
    # the outer form: a plain explode would filter on the array first, and compute it again for that
    c = found.select(F.explode_outer("__found").alias("c")).filter("c is not null")
    counts = c.groupBy("c.kind", "c.votes", "c.feature").count().collect()
    return fit_spans(sorted((r["kind"], r["votes"], r["feature"], r["count"]) for r in counts))


def with_spans(df: DataFrame, text_col: str, model: dict[str, float], threshold: float = 0.5) -> DataFrame:
    """Adds __spans, an array of (rank, start, end, kind, base), by kind and start."""
    good = [k for k, p in sorted(model.items()) if p >= threshold]
    key = lambda c: F.concat_ws("|", c["kind"], c["votes"], c["feature"])
    picked = lambda c: c["base"] | key(c).isin(*good) if good else c["base"]
    df = with_candidates(df, text_col).withColumn("__found", F.filter("__found", picked))
    df = df.withColumn("__base", F.filter("__found", lambda c: c["base"]))
    free = F.filter("__found", lambda c: c["base"] | ~F.exists("__base", lambda b: (b["kind"] == c["kind"]) & (b["start"] < c["end"]) & (c["start"] < b["end"])))
    rank = F.create_map(*(x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))))
    slim = F.transform(free, lambda c: F.struct(rank[c["kind"]].alias("rank"), c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"), c["base"].alias("base")))
    return df.withColumn("__spans", F.array_sort(slim)).drop("__found", "__base")


def _listed(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda c: F.concat_ws(":", c["kind"], c["start"].cast("string"), c["end"].cast("string"))), ",")


def _apart(df: DataFrame, text_col: str) -> DataFrame:
    """The rows as one column ``row`` and the text beside it, so that no name of the caller's meets one of the columns in use here."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.col(text_col).alias("text"))


def personal_data(df: DataFrame, model: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row.

    The counts and base_sha256 are of the base spans, ``spans`` lists all. Null and empty texts have none (zero counts, the digest of
    the empty string, an empty list); null ids and repeated rows stay; an empty table gives no rows and fits nothing. Other columns are
    not read, whatever their names.
    """
    model = fit(df, text_col) if model is None else model
    found = with_spans(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", model).withColumnRenamed("__spans", "found")
    base = F.filter("found", lambda c: c["base"])
    of = lambda k: F.filter(base, lambda c: c["kind"] == k)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select(F.col("id").alias(id_col), *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("found")).alias("spans"))


def redact(df: DataFrame, model: dict[str, float] | None = None, text_col: str = "text") -> DataFrame:
    """The table with every span replaced by <KIND>; of overlapping spans, the first is replaced as far as they reach. Texts without
    spans, null ones among them, stay as they are, and so do all other columns, whatever their names."""
    model = fit(df, text_col) if model is None else model
    text = F.col("text")
    found = F.array_sort(F.transform("__spans", lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"))))
    out = with_spans(_apart(df, text_col), "text", model).withColumn("__found", found)
    zero = F.struct(F.lit(0).cast("bigint").alias("pos"), F.array().cast("array<string>").alias("out"))
    cut = lambda a, b: F.substring(text, (a + 1).cast("int"), (b - a).cast("int"))

    def step(a: Column, c: Column) -> Column:
        new = F.concat(a["out"], F.array(cut(a["pos"], c["start"]), F.concat(F.lit("<"), F.upper(c["kind"]), F.lit(">"))))
        return F.struct(F.greatest(a["pos"], c["end"]).alias("pos"), F.when(c["start"] >= a["pos"], new).otherwise(a["out"]).alias("out"))

    whole = F.aggregate("__found", zero, step, lambda a: F.array_join(F.concat(a["out"], F.array(cut(a["pos"], F.length(text).cast("bigint")))), ""))
    changed = F.when(F.size("__found") > 0, whole).otherwise(text)
    return out.select(*(changed.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in df.columns))
