"""Common table expressions of the oracle SQL, in DuckDB's dialect."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from kelpie.functions.text import folded

R = "r AS (SELECT DISTINCT * FROM records)"
DOT = "list_dot_product({a}::DOUBLE[], {b}::DOUBLE[])"
V = """v AS (SELECT id, min(vec::DOUBLE[]) AS vec FROM vecs WHERE id IS NOT NULL AND len(vec) = 64
 AND len(list_filter(vec, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(vec, lambda x: x <> 0)) > 0 GROUP BY id)"""
U = f"{V}, u AS (SELECT id, list_transform(vec, lambda x: x / sqrt({DOT.format(a='vec', b='vec')})) AS vec FROM v)"


@lru_cache(maxsize=1)
def _folding() -> tuple[str, str, str, list[tuple[str, str]]]:
    single, gone, several = [], [], []
    for cp in range(0x80, 0x1F000):
        c = chr(cp)
        if unicodedata.category(c) in ("Cn", "Cs", "Co") or 0xAC00 <= cp < 0xD7B0:
            continue
        f = folded(c)
        if f == c:
            continue
        if len(f) == 1:
            single.append((c, f))
        elif not f:
            gone.append(c)
        elif cp < 0x300 or cp == 0x0E33 or 0x2000 <= cp < 0x2200 or 0xFB00 <= cp < 0xFB07:
            several.append((c, f))
    return "".join(a for a, _ in single), "".join(b for _, b in single), "".join(gone), several


def fold(expression: str) -> str:
    """The folding of texts, code point by code point: replaced, dropped, or (ligatures and the like) spelled out."""
    a, b, gone, several = _folding()
    k = "(unicode(c) - 44032)"
    jamo = f"chr((4352 + {k} // 588)::INT) || chr((4449 + ({k} % 588) // 28)::INT) || CASE WHEN {k} % 28 > 0 THEN chr((4519 + {k} % 28)::INT) ELSE '' END"
    spelled = f"array_to_string(list_transform(string_split({expression}, ''), lambda c: CASE WHEN unicode(c) BETWEEN 44032 AND 55203 THEN {jamo} ELSE c END), '')"
    out = f"lower(CASE WHEN regexp_matches({expression}, '[\\x{{AC00}}-\\x{{D7A3}}]') THEN {spelled} ELSE {expression} END)"
    for x, y in several:
        x, y = x.replace("'", "''"), y.replace("'", "''")
        out = f"replace({out}, '{x}', '{y}')"
    a, b = (a + gone).replace("'", "''"), b.replace("'", "''")
    return f"translate({out}, '{a}', '{b}')"


@lru_cache(maxsize=1)
def tok() -> str:
    return f"tok AS (SELECT id, t, len(t) AS dl FROM (SELECT id, regexp_extract_all({fold('coalesce(text, chr(32))')}, '[\\p{{L}}\\p{{N}}]+') AS t FROM r))"


POST = "post AS (SELECT term, id, count(*) AS tf, any_value(dl) AS dl FROM (SELECT id, dl, unnest(t) AS term FROM tok) GROUP BY term, id)"
DF = "df AS (SELECT term, count(*) AS df FROM post GROUP BY term)"
STATS = "stats AS (SELECT count(*) AS total, avg(dl) AS avgdl, avg(dl) FILTER (dl > 0) AS filled FROM tok)"
Q = "q AS (SELECT qid, term, count(*) AS qtf, min(pos) AS pos FROM (SELECT id AS qid, unnest(t[1:100]) AS term, unnest(range(len(t[1:100]))) AS pos FROM tok WHERE id % 100 = 0) GROUP BY qid, term)"
IDF = "greatest(ln((total - least(df, total) + 0.5::DOUBLE) / (least(df, total) + 0.5::DOUBLE)), 1e-6::DOUBLE)"


def sat(tf: str, dl: str, avgdl: str) -> str:
    return f"({tf} * 2.2::DOUBLE / ({tf} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * {dl} / {avgdl})))"


def index() -> str:
    return ", ".join((R, tok(), POST, DF, STATS, Q))


def top(source: str, k: int = 10, tie: str = "id", score: str = "round(score, 6)", by: str = "qid") -> str:
    return f"SELECT qid, id, {score} AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY round(score, 9) DESC, {tie}) AS rank FROM {source}) WHERE rank <= {k}"


def single(allowed: str = "", q: str = "q") -> str:
    """BM25 of the queries' terms; ``allowed`` restricts the hits."""
    where = f"WHERE id IN ({allowed})" if allowed else ""
    return f"(SELECT qid, id, sum(qtf * {IDF} * {sat('tf', 'dl', 'avgdl')}) AS score FROM {q} JOIN df USING (term) JOIN post USING (term), stats {where} GROUP BY qid, id)"


def cosines(rows: str = "u", where: str = "true") -> str:
    return f"(SELECT q.id AS qid, x.id, list_dot_product(q.vec, x.vec) AS score FROM u q, {rows} x WHERE q.id % 100 = 0 AND {where})"


def typed(key: str) -> tuple[str, str, str]:
    """(number, text, rendered) of a top-level metadata key."""
    m = f"CASE WHEN json_valid(metadata) THEN metadata END"
    kind, raw = f"json_type({m}, '$.{key}')", f"json_extract_string({m}, '$.{key}')"
    num = f"CASE WHEN {kind} = 'BOOLEAN' THEN ({raw} = 'true')::INT::DOUBLE WHEN {kind} IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN {raw}::DOUBLE END"
    txt = f"CASE WHEN {kind} IN ('VARCHAR', 'ARRAY', 'OBJECT') THEN {raw} END"
    rendered = f"CASE WHEN {kind} = 'BOOLEAN' THEN ({raw} = 'true')::INT::VARCHAR WHEN {kind} <> 'NULL' THEN {raw} END"
    return f"({num})", f"({txt})", f"({rendered})"


def ascii_lower(x: str) -> str:
    return f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
