"""DuckDB twins of the Spark plans, used as an independent correctness oracle.

Each builder returns DuckDB SQL text.  The expressions follow the same
definitions as ``qaspark.functions`` but are written independently with
DuckDB list lambdas; nothing is shared with the Spark code except the
fixed values (regex class, separators, thresholds).
"""

from __future__ import annotations

from ..functions.text import LEV_ACC_THRESHOLD, ROUGE_ACC_THRESHOLD
from .run_log import RUN_LOG_SQL


def norm(x: str) -> str:
    return rf"trim(regexp_replace(lower(coalesce({x}, '')), '[^\p{{L}}\p{{N}}_-]+', ' ', 'g'))"


def toks(n: str) -> str:
    return f"list_filter(string_split({n}, ' '), lambda _t: _t <> '')"


def strip_ws(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def refs(x: str) -> str:
    xs = strip_ws(x)
    parts = (f"list_filter(list_transform(string_split({xs}, '|||'), lambda _p: {strip_ws('_p')}), "
             f"lambda _p: _p <> '')")
    return (f"(CASE WHEN {x} IS NULL THEN ['']"
            f" WHEN contains({xs}, '|||') THEN (CASE WHEN len({parts}) = 0 THEN [''] ELSE {parts} END)"
            f" WHEN starts_with({xs}, '[') AND ends_with({xs}, ']') AND json_valid({xs})"
            f" AND json_type({xs}) = 'ARRAY'"
            f" THEN (CASE WHEN json_array_length({xs}) = 0 THEN ['']"
            f" ELSE CAST(from_json({xs}, '[\"VARCHAR\"]') AS VARCHAR[]) END)"
            f" ELSE [{x}] END)")


def f1_tokens(pt: str, rt: str) -> str:
    """Token F1 of two token lists (multiset overlap)."""
    common = (f"coalesce(list_sum(list_transform(list_distinct({pt}), lambda _u: least("
              f"len(list_filter({pt}, lambda _y: _y = _u)), len(list_filter({rt}, lambda _y: _y = _u))))), 0)")
    return f"(CASE WHEN len({pt}) + len({rt}) = 0 THEN 1.0 ELSE 2.0 * {common} / (len({pt}) + len({rt})) END)"


def lev_sim(a: str, b: str) -> str:
    """Levenshtein similarity by code point.

    DuckDB's levenshtein counts bytes, so each pair's distinct characters
    are first renamed to single-byte characters chr(1..127).  The renaming
    is injective within the pair, so the distance is exact; a pair with
    more than 127 distinct characters yields null.
    """
    alpha = f"list_distinct(string_split({a} || {b}, ''))"
    def remap(s):
        return (f"array_to_string(list_transform(string_split({s}, ''), "
                f"lambda _ch: chr(list_position(_al, _ch))), '')")
    return (f"(CASE WHEN length({a}) = 0 AND length({b}) = 0 THEN 1.0 "
            f"WHEN length({a}) = 0 OR length({b}) = 0 THEN 0.0 "
            f"ELSE (SELECT CASE WHEN len(_al) > 127 THEN NULL ELSE "
            f"1.0 - levenshtein({remap(a)}, {remap(b)}) / greatest(length({a}), length({b})) END "
            f"FROM (SELECT {alpha} AS _al)) END)")


def lcs_cte(pairs: str, key: str = "pair_id") -> str:
    """CTEs computing ``rouge(pair_key, ref_no, LCS)`` for token lists.

    ``pairs`` must be a relation (key, ref_no, pt, rt).  The DP runs row by
    row in a recursive CTE: c[j] = max(prev[j], match ? prev[j-1] + 1 : 0),
    new[j] = running max of c over j.
    """
    return f"""
lcs_b AS (
  SELECT {key} AS k, ref_no, unnest(range(1, len(rt) + 1)) AS j, unnest(rt) AS tb, len(pt) AS n
  FROM {pairs} WHERE len(pt) > 0 AND len(rt) > 0
), lcs_a AS (
  SELECT {key} AS k, ref_no, unnest(range(1, len(pt) + 1)) AS i, unnest(pt) AS ta
  FROM {pairs} WHERE len(pt) > 0 AND len(rt) > 0
), lcs_dp AS (
  SELECT k, ref_no, 0 AS i, j, 0 AS v, n FROM lcs_b
  UNION ALL
  SELECT k, ref_no, i, j, max(c) OVER (PARTITION BY k, ref_no ORDER BY j
                                       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v, n
  FROM (
    SELECT d.k, d.ref_no, d.i + 1 AS i, d.j, d.n,
           greatest(d.v, CASE WHEN b.tb = a.ta
                              THEN coalesce(lag(d.v) OVER (PARTITION BY d.k, d.ref_no ORDER BY d.j), 0) + 1
                              ELSE 0 END) AS c
    FROM lcs_dp d
    JOIN lcs_b b ON b.k = d.k AND b.ref_no = d.ref_no AND b.j = d.j
    JOIN lcs_a a ON a.k = d.k AND a.ref_no = d.ref_no AND a.i = d.i + 1
    WHERE d.i < d.n
  )
), lcs AS (
  SELECT k, ref_no, max(v) AS lcs FROM lcs_dp WHERE i = n GROUP BY k, ref_no
)"""


def rouge_from(pt: str, rt: str, lcs: str) -> str:
    return f"(CASE WHEN len({pt}) + len({rt}) = 0 THEN 1.0 ELSE 2.0 * coalesce({lcs}, 0) / (len({pt}) + len({rt})) END)"


def scored_ctes(source: str = "run_log", key: str = "pair_id", with_rouge: bool = True,
                with_lev: bool = True) -> str:
    """CTE chain ending in ``scored``: build_metrics over ``source``."""
    ctes = f"""
s0 AS (
  SELECT r.*, {norm('r.predicted_answer')} AS _pn, {refs('r.gold_answer')} AS _refs FROM {source} r
), s1 AS (
  SELECT s0.*, list_transform(_refs, lambda _x: {norm('_x')}) AS _rn FROM s0
), s2 AS (
  SELECT s1.*, {toks('_pn')} AS _pt, list_transform(_rn, lambda _x: {toks('_x')}) AS _rt FROM s1
), ref_pairs AS (
  SELECT {key}, _pn AS pn, _pt AS pt, unnest(_rn) AS rn, unnest(_rt) AS rt,
         unnest(range(1, len(_rn) + 1)) AS ref_no
  FROM s2
)"""
    if with_rouge:
        ctes += "," + lcs_cte("ref_pairs", key)
    per_ref = [f"{f1_tokens('p.pt', 'p.rt')} AS f1"]
    if with_rouge:
        per_ref.append(f"{rouge_from('p.pt', 'p.rt', 'l.lcs')} AS rouge")
    if with_lev:
        per_ref.append(f"{lev_sim('p.pn', 'p.rn')} AS lev")
    join_lcs = "LEFT JOIN lcs l ON l.k = p.{key} AND l.ref_no = p.ref_no".format(key=key) if with_rouge else ""
    best = ["max(f1) AS F1"] + (["max(rouge) AS ROUGE_L"] if with_rouge else []) + \
        (["max(lev) AS LEV_SIM"] if with_lev else [])
    ctes += f""",
ref_scores AS (
  SELECT p.{key}, {', '.join(per_ref)} FROM ref_pairs p {join_lcs}
), best AS (
  SELECT {key}, {', '.join(best)} FROM ref_scores GROUP BY {key}
), scored AS (
  SELECT s2.* EXCLUDE (_pn, _refs, _rn, _pt, _rt),
         latency_total_ms / 1000.0 AS latency_total_s,
         latency_retrieval_ms / 1000.0 AS latency_retrieval_s,
         latency_generation_ms / 1000.0 AS latency_generation_s,
         CASE WHEN question IS NULL THEN NULL ELSE len({toks(norm('question'))}) END AS q_len,
         CASE WHEN gold_answer IS NULL THEN NULL ELSE len({toks(norm('gold_answer'))}) END AS gold_len,
         CASE WHEN predicted_answer IS NULL THEN NULL ELSE len(_pt) END AS pred_len,
         list_max(list_transform(_rn, lambda _x: CAST(_pn = _x AS INTEGER))) AS EM,
         b.F1{', b.ROUGE_L, CAST(b.ROUGE_L >= ' + str(ROUGE_ACC_THRESHOLD) + ' AS INTEGER) AS ACC_rouge70' if with_rouge else ''}
         {', b.LEV_SIM, CAST(b.LEV_SIM >= ' + str(LEV_ACC_THRESHOLD) + ' AS INTEGER) AS ACC_lev80' if with_lev else ''}
  FROM s2 JOIN best b USING ({key})
)"""
    return ctes


def with_run_log(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",".join([RUN_LOG_SQL.strip()] + [c.strip() for c in ctes if c.strip()])


# ---------------------------------------------------------------- groundedness twins
def lex_norm(x: str) -> str:
    return (rf"trim(regexp_replace(regexp_replace(lower(strip_accents(coalesce({x}, ''))), "
            rf"'[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))")


def stops(lang: str) -> str:
    from ..functions.grounding import DEFAULT_STOP_LANG, STOP_WORDS

    def lst(ws):
        return "[" + ", ".join("'" + w + "'" for w in ws) + "]"
    whens = " ".join(f"WHEN '{k}' THEN {lst(v)}" for k, v in STOP_WORDS.items() if k != DEFAULT_STOP_LANG)
    return f"(CASE coalesce({lang}, '{DEFAULT_STOP_LANG}') {whens} ELSE {lst(STOP_WORDS[DEFAULT_STOP_LANG])} END)"


def content_toks(norm_expr: str, stops_expr: str) -> str:
    return f"list_filter(string_split({norm_expr}, ' '), lambda _w: length(_w) >= 3 AND NOT list_contains({stops_expr}, _w))"


def bigr(arr: str) -> str:
    return f"list_transform(range(1, len({arr})), lambda _i: {arr}[_i] || ' ' || {arr}[_i + 1])"


def lexical_cols(ans: str, ctx: str, lang: str, prefix: str) -> str:
    """SELECT-list fragment: <prefix>factual / <prefix>halluc / <prefix>mode over token lists."""
    return f"""(SELECT {{'f': CASE WHEN len(a) = 0 OR len(c) = 0 THEN 0.0 ELSE {_rnd('10.0 * s', 2)} END,
                      'h': CASE WHEN len(a) = 0 OR len(c) = 0 THEN 1.0 ELSE {_rnd('1.0 - s', 3)} END,
                      'm': CASE WHEN len(a) = 0 OR len(c) = 0 THEN '' ELSE 'lexical' END}}
   FROM (SELECT a, c, least(1.0, greatest(0.0, 0.75 * (len(list_filter(a, lambda _t: list_contains(cm, _t)))
                                                      / greatest(1, len(a)))
                                      + 0.25 * (CASE WHEN len(ab) > 0 THEN len(list_intersect(ab, cb)) / len(ab)
                                                     ELSE 0.0 END))) AS s
         FROM (SELECT a, c, list_intersect(list_distinct(a), list_distinct(c)) AS cm,
                      list_distinct({bigr('a')}) AS ab, list_distinct({bigr('c')}) AS cb
               FROM (SELECT {content_toks(lex_norm(ans), stops(lang))} AS a,
                            {content_toks(lex_norm(ctx), stops(lang))} AS c)))) AS {prefix}"""


def _rnd(x: str, digits: int) -> str:
    return f"CAST(round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38, 18)), {digits}) AS DOUBLE)"


def sentence_cov(ans: str, ctx: str) -> str:
    words = r"list_transform(regexp_extract_all(_s, '[\p{L}\p{N}_\x{C0}-\x{FF}]{5,}'), lambda _w: lower(_w))"
    hit = (f"(len({words}) > 0 AND len(list_filter({words}, lambda _w: contains(_ctx, _w))) "
           f">= greatest(1, len({words}) // 4))")
    return f"""(SELECT {{'f': {_rnd('greatest(0.0, 10.0 * (1.0 - h))', 2)}, 'h': {_rnd('h', 3)}}} FROM (
      SELECT CASE WHEN len(sents) > 0 THEN 1.0 - len(list_filter(list_transform(sents, lambda _s: {hit}), lambda _x: _x))
                  / len(sents) ELSE 1.0 END AS h
      FROM (SELECT lower(coalesce({ctx}, '')) AS _ctx,
                   list_filter(list_transform(regexp_split_to_array(coalesce({ans}, ''), '[.!?]\\s+'),
                               lambda _p: regexp_replace(_p, '^\\s+|\\s+$', '', 'g')), lambda _p: _p <> '') AS sents)))"""


# ---------------------------------------------------------------- response parsing twins
def d_strip_ws(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def d_oneline(x: str) -> str:
    return d_strip_ws(rf"regexp_replace(coalesce({x}, ''), '\s+', ' ', 'g')")


def d_strip_reasoning(x: str) -> str:
    t = rf"regexp_replace({x}, '(?is)<think>.*?</think>\s*', '', 'g')"
    t = rf"regexp_replace({t}, '(?is)```(?:reasoning|thought|inner_monologue).*?```', '', 'g')"
    t = rf"regexp_replace({t}, '(?im)^\s*(razonamiento|reasoning)\s*:\s*.*$', '', 'g')"
    return f"(CASE WHEN {x} IS NULL OR {x} = '' THEN {x} ELSE {d_strip_ws(t)} END)"


def _d_score(doc: str) -> str:
    # nested CASE: DuckDB evaluates both sides of AND
    return (f"(CASE WHEN json_valid({doc}) THEN CASE WHEN json_type({doc}) = 'OBJECT' "
            f"THEN TRY_CAST(json_extract_string({doc}, '$.score') AS DOUBLE) END END)")


def _d_feedback(doc: str) -> str:
    return (f"(CASE WHEN json_valid({doc}) THEN CASE WHEN json_type({doc}) = 'OBJECT' "
            f"THEN coalesce(json_extract_string({doc}, '$.feedback'), 'None') END END)")


def d_grade(raw: str, version: int = 2) -> str:
    """SELECT-able struct {score, feedback, score_in_range} for a raw grader text."""
    r = d_strip_ws(f"coalesce({raw}, '')")
    if version >= 2:
        r = f"replace(replace(replace({r}, '“', '\"'), '”', '\"'), '’', '''')"
    num = rf"TRY_CAST(nullif(regexp_extract(_r, '(\d+(?:\.\d+)?)', 1), '') AS DOUBLE)"
    if version >= 2:
        blk = (rf"list_filter(list_transform(list_reverse(regexp_extract_all(_r, '(?s)\{{.*?\}}')), "
               f"lambda _b: {{'s': {_d_score('_b')}, 'f': {_d_feedback('_b')}}}), lambda _z: _z.s IS NOT NULL)[1]")
        score = f"coalesce({_d_score('_r')}, _blk.s, {num})"
        fb = d_oneline(f"coalesce(CASE WHEN {_d_score('_r')} IS NOT NULL THEN {_d_feedback('_r')} END, _blk.f, _r)")
        inner = f"SELECT _r, {blk} AS _blk FROM (SELECT {r} AS _r)"
    else:
        score = f"coalesce({_d_score('_r')}, {num})"
        fb = f"coalesce(CASE WHEN {_d_score('_r')} IS NOT NULL THEN {_d_feedback('_r')} END, _r)"
        inner = f"SELECT {r} AS _r"
    return (f"(SELECT {{'score': _sc, 'feedback': _fb, 'score_in_range': _sc BETWEEN 0 AND 10}} "
            f"FROM (SELECT {score} AS _sc, {fb} AS _fb FROM ({inner})))")
