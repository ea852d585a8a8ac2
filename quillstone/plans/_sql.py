"""Pieces of DuckDB SQL that queries share. RE2 has neither lookaround nor back-references, so patterns are spelled out for it."""

from __future__ import annotations

from ..functions import constants as C

WS = r"[ \t\n\x0b\f\r]"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def listed(xs) -> str:
    return "(" + ", ".join(map(quoted, xs)) + ")"


def tidy(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace({x}, '[^\p{{L}}\p{{N}} \t\n\x0b\f\r]', ' ', 'g'), '{WS}+', ' ', 'g'))"


def normalize_claim(x: str) -> str:
    return tidy(f"lower({x})")


def normalize_for_compare(x: str) -> str:
    return tidy(f"regexp_replace(lower({x}), '<[^>]*>', ' ', 'g')")


def words(normal: str) -> str:
    return f"CASE WHEN length({normal}) > 0 THEN string_split({normal}, ' ') ELSE []::VARCHAR[] END"


def tokens(x: str, stops) -> str:
    return f"list_filter({words(normalize_claim(x))}, lambda w: length(w) > 2 AND w NOT IN {listed(stops)})"


def retrieval_tokens(x: str) -> str:
    return tokens(x, C.RETRIEVAL_STOPS)


def content_tokens(x: str) -> str:
    return tokens(x, C.JUDGE_STOPS)


def bounded(pattern: str, x: str, ignore_case: bool = False) -> str:
    return f"regexp_matches({x}, {quoted(('(?i)' if ignore_case else '') + rf'(?:^|[^A-Za-z0-9_])(?:{pattern})(?:[^A-Za-z0-9_]|$)')})"


def hits(pattern: str, x: str) -> str:
    return f"len(regexp_extract_all({x}, {quoted(rf'\b(?:{pattern})\b')}))"


def sentences(x: str) -> str:
    """Trimmed claim sentences, blank ones left out."""
    cut = rf"regexp_replace({x}, '([.!?]){WS}+', '\1' || chr(1), 'g')"
    return rf"list_filter(list_transform(string_split({cut}, chr(1)), lambda s: regexp_replace(s, '^{WS}+|{WS}+$', '', 'g')), lambda s: s <> '')"


def quotable(x: str) -> str:
    flat = f"regexp_replace({x}, '{WS}+', ' ', 'g')"
    cut = rf"""regexp_replace({flat}, '([.!?]) +([A-Z"''“(0-9])', '\1' || chr(1) || '\2', 'g')"""
    raw = f"list_filter(list_transform(string_split({cut}, chr(1)), lambda s: trim(s)), lambda s: s <> '')"
    # done sentences stand before the last mark, what is held after it
    held = "(CASE WHEN regexp_extract(a, '[^\\x02]*$') = '' THEN s ELSE regexp_extract(a, '[^\\x02]*$') || ' ' || s END)"
    step = f"regexp_extract(a, '^(?:[^\\x02]*\\x02)*') || {held} || CASE WHEN length({held}) >= {C.MIN_SENTENCE} THEN chr(2) ELSE '' END"
    folded = f"list_reduce({raw}, lambda a, s: {step}, '')"
    out = f"list_filter(string_split({folded}, chr(2)), lambda s: s <> '')"
    return f"list_filter({out}, lambda s, i: length(s) >= {C.MIN_SENTENCE} OR i = 1)"


def figures(x: str) -> str:
    return rf"list_filter(list_transform(regexp_extract_all({x}, '[0-9][0-9.,]*'), lambda f: try_cast(regexp_replace(replace(f, ',', ''), '\.$', '') AS DOUBLE)), lambda f: f IS NOT NULL)"


def checkworthy(x: str) -> str:
    t = f"trim({x})"
    opinion = quoted(rf"(?i)^(?:{C.OPINION_STARTS})(?:[^A-Za-z0-9_]|$)")
    fact = quoted(rf"[0-9]|(?:^|[^A-Za-z0-9_])(?:[A-Z][a-z]{{2,}}|(?:{C.FACT_VERBS})(?:[^A-Za-z0-9_]|$))")
    return f"(length({t}) >= 25 AND NOT ends_with({t}, '?') AND NOT regexp_matches({t}, {opinion}) AND regexp_matches({t}, {fact}))"


def volatility(x: str) -> str:
    return f"CASE WHEN {bounded(C.FAST_CUES, f'lower({x})')} THEN 'fast' WHEN {bounded(C.LASTING_CUES, f'lower({x})')} THEN 'immutable' ELSE 'slow' END"


def host_of(x: str) -> str:
    return rf"regexp_replace(lower(regexp_extract({x}, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)', 1)), '^www\.', '')"


def entities(x: str) -> str:
    clean = f"translate(coalesce({x}, ''), chr(1), ' ')"
    marked = rf"regexp_replace({clean}, '(^|[.!?]{WS})([A-Z])', '\1' || chr(1) || '\2', 'g')"
    one = r"\x01?[A-Z][A-Za-z0-9_&.-]*"
    runs = rf"list_transform(regexp_extract_all({marked}, '(?:^|[^A-Za-z0-9_])({one}(?:{WS}+(?:of|and|for|the)?{WS}*{one})*)', 1), lambda r: regexp_replace(r, '[^A-Za-z0-9_]+$', ''))"
    named = f"list_filter({runs}, lambda r: NOT (starts_with(r, chr(1)) AND NOT regexp_matches(r, '{WS}')))"
    names = f"list_filter(list_transform({named}, lambda r: replace(r, chr(1), '')), lambda r: length(r) >= 3)"
    acronyms = rf"regexp_extract_all({clean}, '\b[A-Z]{{2,6}}\b')"
    quantities = rf"list_transform(regexp_extract_all({clean}, '(?i)\b[0-9][0-9,.]*{WS}?(?:%|percent|million|billion|trillion|kg|km|mw|gw|tb|gb)\b'), lambda q: trim(q))"
    years = rf"regexp_extract_all({clean}, '\b(?:19|20)[0-9]{{2}}\b')"
    return f"list_distinct(list_concat(list_concat({names}, {acronyms}), list_concat({quantities}, {years})))"


def strip_html(x: str) -> str:
    blocks = "|".join(rf"<{t}\b[^>]*>.*?</{t}>" for t in C.DROPPED_BLOCKS)
    steps = [(f"(?is)(?:{blocks})", " "), ("(?s)<!--.*?-->", " "), (f"(?i)<br{WS}*/?>", "\n"), ("(?i)</(?:p|div|li|h[1-6]|tr)>", "\n"), ("<[^>]+>", " "), *((f"(?i)&{n};", c) for n, c in C.ENTITIES), ("[ \t]+", " "), ("\n{3,}", "\n\n"), (f"^{WS}+|{WS}+$", "")]
    for pattern, new in steps:
        x = f"regexp_replace({x}, {quoted(pattern)}, {quoted(new)}, 'g')"
    return x


def truncated(x: str, n: int) -> str:
    return f"CASE WHEN length({x}) > {n} THEN left({x}, {n - 1}) || '…' ELSE {x} END"


def bm25(queries: str, docs: str, limit: int) -> str:
    """CTEs b_d .. b_top over queries (query_id, query) and docs (id, text); b_top: (query_id, id, score, rank)."""
    return f"""
b_d AS (SELECT id, {retrieval_tokens("text")} AS t FROM {docs}),
b_tot AS (SELECT count(*) AS N, avg(coalesce(len(t), 0)) AS avg_len FROM b_d WHERE t IS NOT NULL),
b_p AS (SELECT token, id, len, count(*) AS tf FROM (SELECT id, len(t) AS len, unnest(t) AS token FROM b_d) GROUP BY ALL),
b_q AS (SELECT query_id, token, count(*) AS times FROM (SELECT query_id, unnest({retrieval_tokens("query")}) AS token FROM {queries}) GROUP BY ALL),
b_df AS (SELECT token, count(*) AS df FROM b_p GROUP BY token),
b_s AS (SELECT query_id, id, round(sum(times * ln(1 + (N - df + 0.5) / (df + 0.5)) * (tf * {C.BM25_K1 + 1} / (tf + {C.BM25_K1} * (1 - {C.BM25_B} + {C.BM25_B} * len / avg_len)))), 6) AS score
  FROM b_q JOIN b_p USING (token) JOIN b_df USING (token), b_tot GROUP BY ALL),
b_top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM b_s) WHERE rank <= {limit})"""


def confidence(verdict: str, ics: str, credibility: str, contradicted: str) -> str:
    base = "CASE " + verdict + " " + " ".join(f"WHEN '{v}' THEN {x}" for v, x in C.BASE_CONFIDENCE.items()) + " END"
    more = f"CASE WHEN {verdict} IN ('SUPPORTED', 'PARTIAL') THEN least(0.2, 0.1 * log2(greatest({ics}, 1) + 1)) ELSE 0 END"
    raw = f"(({base})::DOUBLE + ({more})::DOUBLE + (least(100, greatest(0, {credibility}))::DOUBLE - 50) / 50 * 0.1)"
    return f"round(greatest(0, least(1, CASE WHEN {contradicted} THEN least({raw}, 0.4) ELSE {raw} END)), 3)::DOUBLE"
