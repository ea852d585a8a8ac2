"""Text expressions. All are built-in functions, so that they stay inside code generation. White space is ASCII white space."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as C

WS = r"[ \t\n\x0b\f\r]"
_STRINGS = "array<string>"


def bounded(pattern: str, c: Column, ignore_case: bool = False) -> Column:
    """Whether the pattern occurs as whole ASCII words."""
    return F.rlike(c, F.lit(("(?i)" if ignore_case else "") + rf"(?:^|[^A-Za-z0-9_])(?:{pattern})(?:[^A-Za-z0-9_]|$)"))


def lowered(c: Column) -> Column:
    """Lower case of the text as it is. The optimizer takes lower(upper(x)) for lower(x), which differ where a letter has no capital of
    its own; it does not look behind a concatenation."""
    return F.lower(F.concat(c, F.lit("")))


def _tidy(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, rf"[^\p{{L}}\p{{N}} \t\n\x0b\f\r]", " "), f"{WS}+", " "))


def normalize_claim(c: Column) -> Column:
    """Lower case, letters and digits only, single spaces. Null stays null."""
    return _tidy(lowered(c))


def normalize_for_compare(c: Column) -> Column:
    """As normalize_claim, with markup tags dropped first."""
    return _tidy(F.regexp_replace(lowered(c), "<[^>]*>", " "))


def words(normalized: Column) -> Column:
    """The words of normalized text; none for empty or null."""
    return F.when(F.length(normalized) > 0, F.split(normalized, " ")).otherwise(F.array().cast(_STRINGS))


def runs(w: Column, k: int) -> Column:
    """All runs of k words, in order. Shifted copies are zipped, as a lambda that looked into ``w`` would compute it for each run wherever
    the optimizer moves the expression into a filter."""
    n = F.greatest(F.size(w) - (k - 1), F.lit(0))
    zipped = F.arrays_zip(*(F.slice(w, F.lit(j + 1), n) for j in range(k)))
    return F.transform(zipped, lambda x: F.concat_ws(" ", *(x[str(j)] for j in range(k))))


def shingles(w: Column, k: int = C.SHINGLE) -> Column:
    """Distinct runs of k words; a shorter text is one shingle; none without words."""
    n = F.size(w)
    return F.when(n == 0, F.array().cast(_STRINGS)).when(n < k, F.array(F.array_join(w, " "))).otherwise(F.array_distinct(runs(w, k)))


def _tokens(c: Column, stops: tuple[str, ...]) -> Column:
    """Words of normalize_claim of three letters or more. They are what stands between other characters, so one split finds them."""
    return F.filter(F.split(F.coalesce(lowered(c), F.lit("")), r"[^\p{L}\p{N}]+"), lambda w: (F.length(w) > 2) & ~w.isin(*stops))


def retrieval_tokens(c: Column) -> Column:
    """Words of three letters or more that are not stop words, repeats kept."""
    return _tokens(c, C.RETRIEVAL_STOPS)


def content_tokens(c: Column) -> Column:
    """As retrieval_tokens, with the judge's stop words."""
    return _tokens(c, C.JUDGE_STOPS)


def token_jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays as sets; 0 where either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def truncate(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n - 1)), F.lit("…"))).otherwise(c)


def short_id(c: Column) -> Column:
    """A key of 13 characters: the head of the SHA-256."""
    return F.left(F.sha2(c, 256), F.lit(13))


def host_of(url: Column) -> Column:
    return F.coalesce(F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", ""), F.lit(""))


def normalize_url(url: Column) -> Column:
    """Host and path without www., trailing slashes, fragments and tracking parameters, in lower case."""
    host = F.try_parse_url(url, F.lit("HOST"))
    path = F.regexp_replace(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "/+$", "")
    kept = F.filter(F.split(F.coalesce(F.try_parse_url(url, F.lit("QUERY")), F.lit("")), "&"), lambda p: (p != "") & ~F.rlike(F.lower(p), F.lit(f"^(?:{C.TRACKING})")))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(host.isNull(), F.lower(F.trim(url))).otherwise(F.lower(F.concat(F.regexp_replace(F.lower(host), r"^www\.", ""), path, query)))


def strip_html(html: Column) -> Column:
    """Readable text of a page: furniture and comments dropped, block ends as line ends, entities decoded in order."""
    c = F.regexp_replace(html, rf"(?is)<({'|'.join(C.DROPPED_BLOCKS)})\b[^>]*>.*?</\1>", " ")
    c = F.regexp_replace(c, "(?s)<!--.*?-->", " ")
    c = F.regexp_replace(c, rf"(?i)<br{WS}*/?>", "\n")
    c = F.regexp_replace(c, r"(?i)</(?:p|div|li|h[1-6]|tr)>", "\n")
    c = F.regexp_replace(c, "<[^>]+>", " ")
    for name, char in C.ENTITIES:
        c = F.regexp_replace(c, f"(?i)&{name};", char)
    c = F.regexp_replace(F.regexp_replace(c, "[ \t]+", " "), "\n{3,}", "\n\n")
    return F.regexp_replace(c, rf"^{WS}+|{WS}+$", "")


def clamp(c: Column, most: int = 2_000_000) -> Column:
    """The first characters of a fetched page."""
    return F.left(c, F.lit(most))


def figures(c: Column) -> Column:
    """Distinct numbers in order of appearance; grouping commas and a trailing dot are dropped, what is no number then is left out."""
    raw = F.regexp_extract_all(c, F.lit("([0-9][0-9.,]*)"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(raw, lambda x: F.regexp_replace(F.regexp_replace(x, ",", ""), r"\.$", "").try_cast("double")), lambda x: x.isNotNull()))


def claim_sentences(c: Column) -> Column:
    """Trimmed sentences, each with its place; blank ones are left out but counted."""
    parts = F.transform(F.split(c, rf"(?<=[.!?]){WS}+"), lambda s: F.regexp_replace(s, rf"^{WS}+|{WS}+$", ""))
    return F.filter(parts, lambda s: s != "")


def quotable(c: Column) -> Column:
    """Sentences of 40 characters or more: shorter ones are joined to those after them; a short rest counts only if it is all."""
    flat = F.regexp_replace(c, f"{WS}+", " ")
    raw = F.filter(F.transform(F.split(flat, r"""(?<=[.!?]) +(?=[A-Z"'“(0-9])"""), lambda s: F.trim(s)), lambda s: s != "")

    def step(a: Column, s: Column) -> Column:
        held = F.when(a["held"] == "", s).otherwise(F.concat(a["held"], F.lit(" "), s))
        done = F.length(held) >= C.MIN_SENTENCE
        return F.struct(F.when(done, F.concat(a["out"], F.array(held))).otherwise(a["out"]).alias("out"), F.when(done, "").otherwise(held).alias("held"))

    zero = F.struct(F.array().cast(_STRINGS).alias("out"), F.lit("").alias("held"))
    return F.aggregate(raw, zero, step, lambda a: F.when((F.size(a["out"]) == 0) & (a["held"] != ""), F.array(a["held"])).otherwise(a["out"]))


def is_checkworthy(c: Column) -> Column:
    """Long enough, no question, no opinion, and with a number, a name or a factual verb."""
    t = F.trim(c)
    opinion = F.rlike(t, F.lit(rf"(?i)^(?:{C.OPINION_STARTS})(?:[^A-Za-z0-9_]|$)"))
    fact = F.rlike(t, F.lit(rf"[0-9]|(?:^|[^A-Za-z0-9_])(?:[A-Z][a-z]{{2,}}|(?:{C.FACT_VERBS})(?:[^A-Za-z0-9_]|$))"))
    return F.coalesce((F.length(t) >= 25) & ~t.endswith("?") & ~opinion & fact, F.lit(False))


def volatility(c: Column) -> Column:
    """fast, immutable or slow: how soon a claim may change."""
    t = F.lower(c)
    return F.when(bounded(C.FAST_CUES, t), "fast").when(bounded(C.LASTING_CUES, t), "immutable").otherwise("slow")


def is_fresh(last_verified: Column, kind: Column, now: Column) -> Column:
    """Whether less than the class's time to live has passed (milliseconds); unknown classes count as slow."""
    days = F.when(kind == "immutable", C.TTL_DAYS["immutable"]).when(kind == "fast", C.TTL_DAYS["fast"]).otherwise(C.TTL_DAYS["slow"])
    return F.coalesce((last_verified != 0) & (now - last_verified < days.cast("long") * 86_400_000), F.lit(False))


#: Runs of capitalised words; the mark stands where a sentence begins. Nothing follows a run that could fail, so giving words back is of no
#: use; the possessive repeat says so, and unlike a plain one it takes no stack for each word.
_CAPITALS = r"\x01?[A-Z][A-Za-z0-9_&.-]*(?:[ \t\n\x0b\f\r]+(?:of|and|for|the)?[ \t\n\x0b\f\r]*\x01?[A-Z][A-Za-z0-9_&.-]*)*+"
_QUANTITY = r"[0-9][0-9,.]*[ \t\n\x0b\f\r]?(?:%(?=[A-Za-z0-9_])|(?:percent|million|billion|trillion|kg|km|mw|gw|tb|gb)(?![A-Za-z0-9_]))"


def entities(c: Column) -> Column:
    """Distinct names, acronyms, quantities and years. A single capitalised word that begins a sentence is no name. A run ends in a
    letter, digit or underscore; one of fewer than three characters is no name."""
    # replace() searches bytes and leaves most texts as they are, where translate() maps each character
    drop = lambda x, to: F.replace(x, F.lit("\x01"), F.lit(to))
    clean = drop(F.coalesce(c, F.lit("")), " ")
    marked = F.regexp_replace(clean, r"(^|[.!?][ \t\n\x0b\f\r])(?=[A-Z])", "$1\x01")
    runs = F.transform(F.regexp_extract_all(marked, F.lit(f"(?<![A-Za-z0-9_])({_CAPITALS})"), F.lit(1)), lambda r: F.regexp_replace(r, "[^A-Za-z0-9_]+$", ""))
    names = F.transform(F.filter(runs, lambda r: ~(r.startswith("\x01") & ~F.rlike(r, F.lit(WS)))), lambda r: drop(r, ""))
    names = F.filter(names, lambda r: F.length(r) >= 3)
    acronyms = F.regexp_extract_all(clean, F.lit("(?<![A-Za-z0-9_])([A-Z]{2,6})(?![A-Za-z0-9_])"), F.lit(1))
    quantities = F.transform(F.regexp_extract_all(clean, F.lit(rf"(?i)(?<![A-Za-z0-9_])({_QUANTITY})"), F.lit(1)), lambda s: F.trim(s))
    years = F.regexp_extract_all(clean, F.lit("(?<![A-Za-z0-9_])((?:19|20)[0-9]{2})(?![A-Za-z0-9_])"), F.lit(1))
    return F.array_distinct(F.concat(names, acronyms, quantities, years))


def dedupe_strings(xs: Column) -> Column:
    """Trimmed strings in order, blank ones and later ones that differ only by case left out."""
    trimmed = F.filter(F.transform(xs, lambda s: F.trim(s)), lambda s: s != "")

    def step(a: Column, s: Column) -> Column:
        new = ~F.array_contains(a["seen"], F.lower(s))
        return F.struct(F.when(new, F.concat(a["seen"], F.array(F.lower(s)))).otherwise(a["seen"]).alias("seen"), F.when(new, F.concat(a["out"], F.array(s))).otherwise(a["out"]).alias("out"))

    none = F.array().cast(_STRINGS)
    return F.aggregate(trimmed, F.struct(none.alias("seen"), none.alias("out")), step, lambda a: a["out"])


def safe_name(c: Column) -> Column:
    return F.left(F.trim(F.regexp_replace(c, r'[\\/:*?"<>|#^\[\]]', "-")), F.lit(100))


def fill(template: str, c: Column) -> Column:
    """The template with {} replaced by the column."""
    before, _, after = template.partition("{}")
    return F.concat(F.lit(before), c, F.lit(after))
