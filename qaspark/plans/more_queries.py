"""Catalog entries for the operators beyond the analysis reports."""

from __future__ import annotations

from ..operators import reports as rp
from ..operators.bootstrap import bootstrap_ci, bootstrap_ci_sql
from .catalog import _means_sql, _r, register, scored
from .oracle import scored_ctes, with_run_log

# ---------------------------------------------------------------- A2 bootstrap


#: What tells the pairs of the run log apart.
PAIR = ["conv_id", "turn"]


def _boot_sql(by):
    cols = by + [f"{_r(c)} AS {c}" for m in rp.CI_METRICS for c in (f"{m}_ci_lo", f"{m}_ci_hi")]
    return with_run_log(scored_ctes(), f"ci AS ({bootstrap_ci_sql('scored', by, rp.CI_METRICS, PAIR)})") + " SELECT " + ", ".join(cols) + " FROM ci"


@register("bootstrap_ci_hash_by_llm", _boot_sql(["llm"]))
def q_boot_llm(spark, sf):
    return rp.round_doubles(bootstrap_ci(scored(spark, sf), ["llm"], rp.CI_METRICS, PAIR))


@register("bootstrap_ci_hash_by_language_embedding", _boot_sql(["language", "embedding"]))
def q_boot_lang_emb(spark, sf):
    return rp.round_doubles(bootstrap_ci(scored(spark, sf), ["language", "embedding"], rp.CI_METRICS, PAIR))


def _full_report_sql(by):
    """A1 + A2 + J5: means joined (null-safe) to the intervals."""
    ci_cols = [f"{_r('c.' + c)} AS {c}" for m in rp.CI_METRICS for c in (f"{m}_ci_lo", f"{m}_ci_hi")]
    on = " AND ".join(f"m.{k} IS NOT DISTINCT FROM c.{k}" for k in by)
    return (with_run_log(scored_ctes(), f"ci AS ({bootstrap_ci_sql('scored', by, rp.CI_METRICS, PAIR)})", f"means AS ({_means_sql(by)})")
            + f" SELECT m.*, {', '.join(ci_cols)} FROM means m LEFT JOIN ci c ON {on}")


def _full_report(by):
    return lambda spark, sf: rp.round_doubles(rp.agg_with_ci(scored(spark, sf), by, PAIR))


register("report_by_llm_with_ci", _full_report_sql(["llm"]))(_full_report(["llm"]))
register("report_by_answer_lang_with_ci", _full_report_sql(["language"]))(_full_report(["language"]))
register("report_by_answer_lang_with_ci_hash", _full_report_sql(["language"]))(_full_report(["language"]))

# ---------------------------------------------------------------- J3 / W4 / G4 retrieval
from ..operators import retrieval as rt  # noqa: E402
from ..sources.tables import table  # noqa: E402


def _emb_topk(spark, sf, k=3):
    e = table(spark, sf, "embeddings")
    return rt.topk_similar(e, e, k, "vec_id", "vec_id", "embedding", "embedding", exclude_self=True)


_TOPK_CTE = """
e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings WHERE embedding IS NOT NULL),
n AS (SELECT vec_id, v, label, CASE WHEN sqrt(list_dot_product(v, v)) = 0 THEN 1.0
                                    ELSE sqrt(list_dot_product(v, v)) END AS nrm FROM e),
p AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, list_dot_product(a.v, b.v) / (a.nrm * b.nrm) AS sim
      FROM n a JOIN n b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
topk AS (SELECT * FROM (SELECT p.*, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, doc_id) AS rank
                        FROM p) WHERE rank <= 3)"""


@register("topk_retrieval", f"WITH {_TOPK_CTE} SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, "
                            f"{_r('sim')} AS sim FROM topk")
def q_topk_retrieval(spark, sf):
    return rp.round_doubles(_emb_topk(spark, sf))


@register("retrieval_label_precision", f"""WITH {_TOPK_CTE},
per_q AS (SELECT t.query_id, q.label AS q_label, avg(CAST(q.label = d.label AS DOUBLE)) AS precision
          FROM topk t JOIN e q ON q.vec_id = t.query_id JOIN e d ON d.vec_id = t.doc_id GROUP BY 1, 2)
SELECT q_label AS label, count(*) AS n_queries, {_r('avg(precision)')} AS precision_at_k FROM per_q GROUP BY 1""")
def q_label_precision(spark, sf):
    return rp.round_doubles(rt.label_precision(_emb_topk(spark, sf), table(spark, sf, "embeddings"),
                                               "vec_id", "label"))


@register("semantic_support", f"""WITH {_TOPK_CTE},
s AS (SELECT query_id, least(1.0, greatest(0.0, (max(sim) + 1.0) / 2.0)) AS s FROM topk GROUP BY 1)
SELECT query_id, {_r('10.0 * s', 2)} AS factual_consistency_0_10, {_r('1.0 - s', 3)} AS hallucination_rate_0_1,
       'semantic' AS groundedness_mode FROM s""")
def q_semantic_support(spark, sf):
    return rt.semantic_support(_emb_topk(spark, sf))

# ---------------------------------------------------------------- G1/G2/G7/G8 groundedness
from pyspark.sql import functions as F  # noqa: E402

from ..functions import grounding as gr  # noqa: E402
from ..plans.run_log import run_log  # noqa: E402
from .oracle import lexical_cols, sentence_cov  # noqa: E402


def run_log_with_context(spark, sf):
    """Run log plus its context: the document of the conversation (doc_id = conv_id).

    Dealt anew by pair: what works on the texts takes longer than the join, and a conversation with many pairs is one key of it.
    """
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("conv_id"), F.col("text").alias("context"))
    return run_log(spark, sf).join(docs, "conv_id", "left").repartition("pair_id")


_CTX_SQL = "rc AS (SELECT r.*, d.text AS context FROM run_log r LEFT JOIN documents d ON d.doc_id = r.conv_id)"


@register("lexical_support", with_run_log(_CTX_SQL) + f"""
SELECT pair_id, gp.f AS factual_consistency_0_10, gp.h AS hallucination_rate_0_1,
       {_r('gp.f / 10.0', 3)} AS groundedness_pred_0_1, {_r('gg.f / 10.0', 3)} AS retrieval_support_gold_0_1,
       gp.m AS groundedness_mode_pred, gg.m AS retrieval_support_mode_gold
FROM (SELECT pair_id, {lexical_cols('predicted_answer', 'context', 'language', 'gp')},
             {lexical_cols('gold_answer', 'context', 'language', 'gg')} FROM rc)""")
def q_lexical_support(spark, sf):
    d = gr.add_lexical_supports(run_log_with_context(spark, sf), {"gp": "predicted_answer", "gg": "gold_answer"}, "context", "language")
    return d.select("pair_id", F.col("gp.factual_consistency_0_10"), F.col("gp.hallucination_rate_0_1"),
                    gr.support_ratio("gp.factual_consistency_0_10").alias("groundedness_pred_0_1"),
                    gr.support_ratio("gg.factual_consistency_0_10").alias("retrieval_support_gold_0_1"),
                    F.col("gp.mode").alias("groundedness_mode_pred"),
                    F.col("gg.mode").alias("retrieval_support_mode_gold"))


@register("sentence_coverage", with_run_log(_CTX_SQL) + f"""
SELECT pair_id, sc.f AS factual_consistency_0_10, sc.h AS hallucination_rate_0_1
FROM (SELECT pair_id, {sentence_cov('predicted_answer', 'context')} AS sc FROM rc)""")
def q_sentence_coverage(spark, sf):
    d = gr.add_sentence_coverage(run_log_with_context(spark, sf).select("pair_id", "predicted_answer", "context"),
                                 "predicted_answer", "context", "sc")
    return d.select("pair_id", "sc.factual_consistency_0_10", "sc.hallucination_rate_0_1")


@register("grounded_by_quality", with_run_log(_CTX_SQL) + f"""
SELECT l.quality, l.toxic, count(*) AS n,
       {_r('avg(TRY_CAST(gp.f / 10.0 AS DECIMAL(28, 9)))')} AS groundedness_mean,
       {_r('avg(TRY_CAST(gp.h AS DECIMAL(28, 9)))')} AS halluc_rate_mean
FROM (SELECT conv_id, {lexical_cols('predicted_answer', 'context', 'language', 'gp')} FROM rc) g
JOIN labels l ON l.doc_id = g.conv_id GROUP BY l.quality, l.toxic""")
def q_grounded_by_quality(spark, sf):
    d = gr.add_lexical_support(run_log_with_context(spark, sf), "predicted_answer", "context", "language", "gp")
    lab = table(spark, sf, "labels").select(F.col("doc_id").alias("conv_id"), "quality", "toxic")
    j = d.join(lab, "conv_id")
    return rp.round_doubles(j.groupBy("quality", "toxic").agg(
        F.count("*").alias("n"),
        rp.exact_mean(F.col("gp.factual_consistency_0_10") / 10.0).alias("groundedness_mean"),
        rp.exact_mean("gp.hallucination_rate_0_1").alias("halluc_rate_mean")))

# ---------------------------------------------------------------- R1/R2/R4/R7-R10 responses
from ..functions import responses as rs  # noqa: E402
from ..plans.run_log import qa_pairs  # noqa: E402
from .oracle import d_grade, d_oneline, d_strip_reasoning  # noqa: E402

def _nl():
    return F.lit("\n")


def _raw_responses(spark, sf):
    """Model outputs with reasoning wrapped around the assistant turn, three shapes."""
    p = qa_pairs(spark, sf).withColumn("pair_id", F.col("conv_id") * 100 + F.col("turn"))
    v = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(3))
    raw = (F.when(v == 0, F.concat(F.lit("<think>"), F.col("question"), F.lit("</think>"), _nl(), F.col("answer")))
           .when(v == 1, F.concat(F.lit("```reasoning"), _nl(), F.col("question"), _nl(), F.lit("```"), _nl(),
                                  F.col("answer")))
           .otherwise(F.concat(F.lit("Reasoning: "), F.regexp_replace("question", "\n", " "), _nl(), F.col("answer"))))
    return p.select("pair_id", raw.alias("raw"))


_RAW_RESP_SQL = """
raw_resp AS (
  SELECT u.conv_id * 100 + u.turn AS pair_id,
         CASE (u.conv_id + u.turn) % 3
           WHEN 0 THEN '<think>' || u.text || '</think>' || chr(10) || a.text
           WHEN 1 THEN '```reasoning' || chr(10) || u.text || chr(10) || '```' || chr(10) || a.text
           ELSE 'Reasoning: ' || replace(u.text, chr(10), ' ') || chr(10) || a.text END AS raw
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant'
)"""


@register("strip_reasoning", f"WITH {_RAW_RESP_SQL} SELECT pair_id, {d_oneline(d_strip_reasoning('raw'))} AS answer "
                             "FROM raw_resp")
def q_strip_reasoning(spark, sf):
    return _raw_responses(spark, sf).select("pair_id", rs.oneline(rs.strip_reasoning("raw")).alias("answer"))


def _events(spark, sf):
    return table(spark, sf, "events")


def _raw_grades(spark, sf):
    e = _events(spark, sf)
    v = F.pmod("event_id", F.lit(6))
    sc = F.round(F.col("value") / 5.0, 2).cast("string")
    raw = (F.when(v == 0, F.concat(F.lit('{"score": '), sc, F.lit(', "feedback": "'), F.col("event_type"),
                                   F.lit(' ok"}')))
           .when(v == 1, F.concat(F.lit('Primero {"score": 1} luego {"score": '), sc, F.lit(', "feedback": "'),
                                  F.col("event_type"), F.lit('"}')))
           .when(v == 2, F.concat(F.lit("Nota: "), F.col("value").cast("string"), F.lit(" de 10")))
           .when(v == 3, F.lit("sin nota"))
           .when(v == 4, F.concat(F.lit("{“score”: "), sc, F.lit(", “feedback”: “"), F.col("event_type"),
                                  F.lit("”}")))
           .otherwise(F.concat(F.lit('{"score": "'), sc, F.lit('"}'))))
    return e.select("event_id", raw.alias("raw"))


_RAW_GRADE_SQL = """
raw_grade AS (
  SELECT event_id, CASE event_id % 6
    WHEN 0 THEN '{"score": ' || CAST(round(value / 5.0, 2) AS VARCHAR) || ', "feedback": "' || event_type || ' ok"}'
    WHEN 1 THEN 'Primero {"score": 1} luego {"score": ' || CAST(round(value / 5.0, 2) AS VARCHAR)
                || ', "feedback": "' || event_type || '"}'
    WHEN 2 THEN 'Nota: ' || CAST(value AS VARCHAR) || ' de 10'
    WHEN 3 THEN 'sin nota'
    WHEN 4 THEN '{“score”: ' || CAST(round(value / 5.0, 2) AS VARCHAR) || ', “feedback”: “' || event_type || '”}'
    ELSE '{"score": "' || CAST(round(value / 5.0, 2) AS VARCHAR) || '"}' END AS raw
  FROM events
)"""


@register("grade_parse_v2", f"WITH {_RAW_GRADE_SQL} SELECT event_id, g.score, g.feedback, g.score_in_range "
                            f"FROM (SELECT event_id, {d_grade('raw', 2)} AS g FROM raw_grade)")
def q_grade_v2(spark, sf):
    return _raw_grades(spark, sf).select("event_id", rs.grade_parse("raw", 2).alias("g")).select(
        "event_id", "g.score", "g.feedback", "g.score_in_range")


@register("grade_parse_v1", f"WITH {_RAW_GRADE_SQL} SELECT event_id, g.score, g.feedback, g.score_in_range "
                            f"FROM (SELECT event_id, {d_grade('raw', 1)} AS g FROM raw_grade)")
def q_grade_v1(spark, sf):
    return _raw_grades(spark, sf).select("event_id", rs.grade_parse("raw", 1).alias("g")).select(
        "event_id", "g.score", "g.feedback", "g.score_in_range")


def _raw_generate(spark, sf):
    e = _events(spark, sf)
    dur = F.when(F.pmod("event_id", F.lit(4)) == 0, F.lit(0)).otherwise(F.round(F.col("value") * 1e8).cast("long"))
    body = F.concat(F.lit('{"response": "<think>plan</think> '), F.col("event_type"), F.lit(' answer",'),
                    F.lit(' "prompt_eval_count": '), F.col("user_id").cast("string"),
                    F.when(F.pmod("event_id", F.lit(7)) == 0, F.lit(""))
                     .otherwise(F.concat(F.lit(', "eval_count": '), F.floor("value").cast("string"))),
                    F.lit(', "eval_duration": '), dur.cast("string"), F.lit("}"))
    return e.select("event_id", body.alias("body"), F.col("value").alias("wall_clock_s"))


@register("response_metrics", r"""
WITH g AS (
  SELECT event_id, value AS wall, '{"response": "<think>plan</think> ' || event_type || ' answer",'
         || ' "prompt_eval_count": ' || CAST(user_id AS VARCHAR)
         || CASE WHEN event_id % 7 = 0 THEN '' ELSE ', "eval_count": ' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) END
         || ', "eval_duration": ' || CAST(CASE WHEN event_id % 4 = 0 THEN 0 ELSE CAST(round(value * 1e8) AS BIGINT) END AS VARCHAR)
         || '}' AS body
  FROM events
), p AS (
  SELECT event_id, wall, json_extract_string(body, '$.response') AS resp,
         CAST(json_extract_string(body, '$.prompt_eval_count') AS BIGINT) AS pt,
         CAST(json_extract_string(body, '$.eval_count') AS BIGINT) AS ct,
         coalesce(CAST(json_extract_string(body, '$.eval_duration') AS DOUBLE), 0.0) AS ns
  FROM g
)
SELECT event_id, """ + d_oneline(d_strip_reasoning(r"regexp_replace(coalesce(resp, ''), '^\s+|\s+$', '', 'g')")) + r""" AS text,
       CAST(pt AS DOUBLE) AS prompt_tokens, CAST(ct AS DOUBLE) AS completion_tokens,
       coalesce(pt, 0) + coalesce(ct, 0) AS total_tokens,
       """ + _r("CASE WHEN ns <> 0 THEN ns / 1e9 ELSE wall END") + r""" AS gen_seconds,
       """ + _r("CASE WHEN (CASE WHEN ns <> 0 THEN ns / 1e9 ELSE wall END) > 0 THEN coalesce(ct, 0) / "
                "(CASE WHEN ns <> 0 THEN ns / 1e9 ELSE wall END) END") + r""" AS tokens_per_sec
FROM p""")
def q_response_metrics(spark, sf):
    d = _raw_generate(spark, sf).select("event_id", rs.response_metrics("body", "wall_clock_s").alias("m"))
    # nullable counts as doubles in both engines (see score_pairs)
    return rp.round_doubles(d.select("event_id", "m.text", F.col("m.prompt_tokens").cast("double").alias("prompt_tokens"),
                                     F.col("m.completion_tokens").cast("double").alias("completion_tokens"),
                                     "m.total_tokens", "m.gen_seconds", "m.tokens_per_sec"))


def _ndjson_chat(spark, sf):
    c = table(spark, sf, "conversations").where(F.col("role") == "assistant")
    lines = F.transform(F.split(F.col("text"), " "),
                        lambda w: F.concat(F.lit('{"message": {"content": "'), w, F.lit(' "}}')))
    body = F.array_join(F.when(F.pmod("turn", F.lit(2)) == 1, F.array_insert(lines, 2, F.lit("{bad json")))
                        .otherwise(lines), "\n")
    return c.select("conv_id", "turn", body.alias("body"))


@register("ndjson_join", r"""
WITH c AS (
  SELECT conv_id, turn, list_transform(string_split(text, ' '), lambda w: '{"message": {"content": "' || w || ' "}}') AS l
  FROM conversations WHERE role = 'assistant'
), b AS (
  SELECT conv_id, turn, array_to_string(CASE WHEN turn % 2 = 1
           THEN list_concat(l[1:1], ['{bad json'], l[2:]) ELSE l END, chr(10)) AS body FROM c
), p AS (
  SELECT conv_id, turn, array_to_string(list_filter(list_transform(
           string_split(regexp_replace(coalesce(body, ''), '^\s+|\s+$', '', 'g'), chr(10)),
           lambda ln: CASE WHEN json_valid(ln) THEN json_extract_string(ln, '$.message.content') END),
           lambda t: t IS NOT NULL), '') AS j FROM b
)
SELECT conv_id, turn, CASE WHEN j = '' THEN '""" + rs.NO_CONTENT_TEXT + r"""'
                           ELSE regexp_replace(j, '^\s+|\s+$', '', 'g') END AS text FROM p""")
def q_ndjson_join(spark, sf):
    return _ndjson_chat(spark, sf).select("conv_id", "turn", rs.ndjson_join("body").alias("text"))


def _pull_logs(spark, sf):
    e = _events(spark, sf)
    status = F.when(F.col("event_type") == "purchase", F.lit(rs.SUCCESS_STATUS)).otherwise(F.col("event_type"))
    body = F.concat(F.lit('{"status": "pulling manifest"}'), _nl(),
                    F.when(F.pmod("event_id", F.lit(5)) == 0, F.lit("not json")).otherwise(
                        F.concat(F.lit('{"status": "'), status, F.lit('"}'))))
    return e.select("event_id", body.alias("body"))


@register("ndjson_status", r"""
WITH b AS (
  SELECT event_id, '{"status": "pulling manifest"}' || chr(10) ||
         CASE WHEN event_id % 5 = 0 THEN 'not json'
              ELSE '{"status": "' || CASE WHEN event_type = 'purchase' THEN 'success' ELSE event_type END || '"}' END AS body
  FROM events
), l AS (SELECT event_id, string_split(regexp_replace(body, '^\s+|\s+$', '', 'g'), chr(10)) AS lines FROM b)
SELECT event_id,
       CASE WHEN json_valid(lines[-1]) THEN coalesce(json_extract_string(lines[-1], '$.status'), '') END AS last_status,
       len(list_filter(lines, lambda ln: CASE WHEN json_valid(ln) THEN json_extract_string(ln, '$.status') = 'success'
                                              ELSE false END)) > 0 AS has_success
FROM l""")
def q_ndjson_status(spark, sf):
    return _pull_logs(spark, sf).select("event_id", rs.ndjson_last_status("body").alias("last_status"),
                                        rs.ndjson_has_success("body").alias("has_success"))

# ---------------------------------------------------------------- J1/J2/P13-P16 grid, W1/W3/P10/P11 positions
from ..operators import grid as gd  # noqa: E402
from ..operators import positions as ps  # noqa: E402


def _grid(spark, sf):
    rl = run_log(spark, sf)
    langs = table(spark, sf, "documents").select("lang")
    return gd.resolve_names(gd.config_grid(rl.select("embedding"), rl.select("llm"), langs))


_GRID_SQL = with_run_log(r"""grid AS (
  SELECT e.embedding, m.llm, g.language, 3 AS top_k,
         replace('data/corpus_{lang}', '{lang}', g.language) AS data_dir,
         concat_ws('_', 'rag', regexp_replace(e.embedding, '[^A-Za-z0-9]+', '_', 'g'), g.language) AS collection,
         'results_' || regexp_replace(m.llm, '[^A-Za-z0-9]+', '_', 'g') || '_'
           || regexp_replace(e.embedding, '[^A-Za-z0-9]+', '_', 'g') || '_' || g.language || '_k3.csv' AS output_csv
  FROM (SELECT DISTINCT embedding FROM run_log) e, (SELECT DISTINCT llm FROM run_log) m,
       (SELECT DISTINCT lang AS language FROM documents) g
)""")


@register("config_grid", _GRID_SQL + " SELECT * FROM grid")
def q_config_grid(spark, sf):
    return _grid(spark, sf)


@register("grid_x_gold", _GRID_SQL + f""" SELECT g.language, g.embedding, g.llm, g.top_k, r.pair_id, r.q_index10
  FROM run_log r JOIN grid g ON g.language = coalesce(nullif(r.language, ''), '{gd.DEFAULT_LANGUAGE}')""")
def q_grid_x_gold(spark, sf):
    gold = run_log(spark, sf).select("language", "pair_id", "q_index10")
    return gd.grid_x_gold(gold, _grid(spark, sf)).select("language", "embedding", "llm", "top_k", "pair_id",
                                                         "q_index10")


@register("question_index", with_run_log() + """ SELECT pair_id, row_pos,
  CAST(((row_pos - 1) // 3) % 10 + 1 AS INTEGER) AS q_index_block,
  CAST(CASE WHEN row_pos % 10 = 0 THEN 10 ELSE row_pos % 10 END AS INTEGER) AS q_index_cyclic
  FROM (SELECT pair_id, row_number() OVER (ORDER BY pair_id) AS row_pos FROM run_log)""")
def q_question_index(spark, sf):
    d = ps.with_row_position(run_log(spark, sf).select("pair_id"), ["pair_id"])
    return d.select("pair_id", "row_pos", ps.question_index_block("row_pos").alias("q_index_block"),
                    ps.question_index_cyclic("row_pos").alias("q_index_cyclic"))


@register("question_index_per_language", """SELECT doc_id, lang,
  row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS idx FROM documents""")
def q_question_index_per_language(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang")
    return ps.with_row_position(d, ["doc_id"], name="idx", partition_by=["lang"])

# ---------------------------------------------------------------- S3-S5/P1-P5/A7/A8/U1 ingest + audit
from ..operators import audit as au  # noqa: E402
from ..sources.files import json_records, json_union  # noqa: E402


def _join(sep, *cols):
    """concat_ws with a column separator (PySpark's takes a literal only)."""
    out = []
    for i, c in enumerate(cols):
        out += ([sep] if i else []) + [c]
    return F.concat(*out)


def line_place(row):
    """(split, blk) of the lines of row ``row`` of a file: as if 2,000 rows were 128 MB, in blocks of 200 rows."""
    n = F.col(row)
    return [(F.floor(n / 2000) * (1 << 27)).cast("long").alias("split"), F.floor(n / 200).cast("long").alias("blk")]


def document_files(spark, sf):
    """``documents`` written as messy result files, one per (language, source).

    Delimiter by source number % 4 (, ; TAB |); header variants by % 3
    (display names / extra score column without n_chars / plain); text is
    quoted except for sources with number % 5 == 4, whose rows with an
    embedded delimiter become bad rows.  Returns the line table.
    """
    d = table(spark, sf, "documents")
    src = F.regexp_extract("source", r"(\d+)$", 1).cast("int")
    delim = F.element_at(F.array(*[F.lit(x) for x in au.DELIMITERS]), (F.pmod(src, F.lit(4)) + 1).cast("int"))
    # odd documents double a quote in a quoted text, even ones put a backslash before it
    quote = F.when(F.pmod("doc_id", F.lit(2)) == 1, F.lit('""')).otherwise(F.lit('\\"'))
    text = F.when(F.pmod(src, F.lit(5)) == 4, F.col("text")).otherwise(
        F.concat(F.lit('"'), F.replace("text", F.lit('"'), quote), F.lit('"')))
    kind = F.pmod(src, F.lit(3))
    rec = F.when(kind == 1, _join(delim, F.col("doc_id").cast("string"), F.col("lang"), text,
                                  F.pmod("n_chars", F.lit(10)).cast("string"))) \
        .otherwise(_join(delim, F.col("doc_id").cast("string"), F.col("lang"), F.col("n_chars").cast("string"), text))
    head = F.when(kind == 0, _join(delim, F.lit("Doc ID"), F.lit("Lang"), F.lit("N chars"), F.lit("Text"))) \
        .when(kind == 1, _join(delim, F.lit("doc_id"), F.lit("lang"), F.lit("text"), F.lit("score"))) \
        .otherwise(_join(delim, F.lit("doc_id"), F.lit("lang"), F.lit("n_chars"), F.lit("text")))
    file = F.concat(F.lit("bench_out_"), F.col("lang"), F.lit("/"), F.col("source"), F.lit(".csv"))
    # physical lines, in their order within the file
    rows = d.select(file.alias("file"), *line_place("doc_id"), "doc_id", F.posexplode(F.split(rec, "\n")).alias("i", "line"))
    rows = rows.select("file", "split", "blk", F.struct("doc_id", "i").alias("ord"), "line")
    heads = d.groupBy("lang", "source").agg(F.first(head).alias("line")).select(
        F.concat(F.lit("bench_out_"), F.col("lang"), F.lit("/"), F.col("source"), F.lit(".csv")).alias("file"),
        F.lit(0).cast("long").alias("split"), F.lit(-1).cast("long").alias("blk"),
        F.struct(F.lit(-1).cast("long").alias("doc_id"), F.lit(0).alias("i")).alias("ord"), "line")
    return heads.unionByName(rows)


_DOC_FILES_SQL = r"""
docs AS (
  SELECT d.*, CAST(regexp_extract(source, '(\d+)$', 1) AS INTEGER) AS src,
         ([',', ';', chr(9), '|'])[CAST(regexp_extract(source, '(\d+)$', 1) AS INTEGER) % 4 + 1] AS dl,
         'bench_out_' || lang || '/' || source || '.csv' AS file
  FROM documents d
), lines AS (
  SELECT DISTINCT file, -1 AS ord,
         CASE src % 3 WHEN 0 THEN concat_ws(dl, 'Doc ID', 'Lang', 'N chars', 'Text')
                      WHEN 1 THEN concat_ws(dl, 'doc_id', 'lang', 'text', 'score')
                      ELSE concat_ws(dl, 'doc_id', 'lang', 'n_chars', 'text') END AS line
  FROM docs
  UNION ALL
  -- a quoted text is one record with its line feeds; an unquoted one is a record for each of its lines
  SELECT file, doc_id + i / 1e6 AS ord, line FROM (
    SELECT file, doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS i FROM (
      SELECT file, doc_id, CASE WHEN src % 5 = 4 THEN string_split(rec, chr(10)) ELSE [rec] END AS parts FROM (
        SELECT *, CASE WHEN src % 3 = 1 THEN concat_ws(dl, CAST(doc_id AS VARCHAR), lang, t, CAST(n_chars % 10 AS VARCHAR))
                       ELSE concat_ws(dl, CAST(doc_id AS VARCHAR), lang, CAST(n_chars AS VARCHAR), t) END AS rec
        FROM (SELECT docs.*, CASE WHEN src % 5 = 4 THEN text
                                  ELSE '"' || replace(text, '"', CASE WHEN doc_id % 2 = 1 THEN '""' ELSE '\"' END) || '"' END AS t
              FROM docs))))
)"""


def _d_fields(line: str, dl: str) -> str:
    return (f"CASE WHEN {line} = '' THEN 0 ELSE len(string_split("
            f"regexp_replace({line}, '\"[^\"\\\\]*(?:(?:\"\"|\\\\.)[^\"\\\\]*)*\"', 'Q', 'gs'), {dl})) END")


def _d_norm(x: str) -> str:
    return (r"regexp_replace(regexp_replace(translate(regexp_replace(lower(trim(" + x + r")), '\s+', ' ', 'g'), "
            r"'ºª', 'oa'), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')")


@register("file_audit", "WITH " + _DOC_FILES_SQL + r""",
hdr AS (
  SELECT file, line AS header,
         (SELECT CASE WHEN c.n > 0 THEN c.d ELSE ',' END FROM (
            SELECT max_by(d, n * 10 - p) AS d, max(n) AS n FROM (
              SELECT unnest([',', ';', chr(9), '|']) AS d, unnest([0, 1, 2, 3]) AS p) x,
              LATERAL (SELECT length(regexp_replace(line, '"[^"]*(?:""[^"]*)*"', '', 'g'))
                              - length(replace(regexp_replace(line, '"[^"]*(?:""[^"]*)*"', '', 'g'), x.d, '')) AS n)) c) AS dl
  FROM lines WHERE ord = -1
), hn AS (
  SELECT file, dl, """ + _d_fields("header", "dl") + r""" AS n_header,
         list_transform(string_split(header, dl), lambda h: """ + _d_norm("h") + r""") AS names FROM hdr
), rec AS (
  SELECT l.file, l.ord, l.line, hn.n_header, hn.dl, """ + _d_fields("l.line", "hn.dl") + r""" AS n_fields
  FROM lines l JOIN hn USING (file) WHERE l.ord <> -1
), ex AS (
  SELECT file, string_agg(substr(regexp_replace(line, '\t|;|\|', ',', 'g'), 1, 200), ' || ' ORDER BY ord) AS bad_examples
  FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY ord) AS rn FROM rec WHERE n_fields <> n_header)
  WHERE rn <= 3 GROUP BY file
), cnt AS (
  SELECT file, count(*) AS n_rows_data, count(*) FILTER (WHERE n_fields <> n_header) AS n_bad_rows_parse
  FROM rec GROUP BY file
), expct AS (SELECT names AS exp FROM hn ORDER BY file LIMIT 1)
SELECT hn.file, hn.dl AS delimiter, coalesce(cnt.n_rows_data, 0) AS n_rows_data,
       coalesce(cnt.n_bad_rows_parse, 0) AS n_bad_rows_parse,
       CAST(len(list_distinct(expct.exp)) AS INTEGER) AS cols_expected_count,
       CAST(len(list_distinct(hn.names)) AS INTEGER) AS cols_found_count,
       array_to_string(list_sort(list_distinct(list_filter(expct.exp, lambda e: NOT list_contains(hn.names, e)))), '|')
         AS cols_missing,
       coalesce(ex.bad_examples, '') AS bad_examples
FROM hn CROSS JOIN expct LEFT JOIN cnt USING (file) LEFT JOIN ex USING (file)""")
def q_file_audit(spark, sf):
    return au.file_audit(document_files(spark, sf))


_UNION_SQL = "WITH " + _DOC_FILES_SQL + r""",
raw AS (
  SELECT file, src, doc_id, unnest(string_split(text, chr(10))) AS part, generate_subscripts(string_split(text, chr(10)), 1) AS i, dl, lang, n_chars
  FROM docs WHERE src % 5 = 4
), unquoted AS (
  SELECT file, src, string_split(CASE WHEN i > 1 THEN part
                                      WHEN src % 3 = 1 THEN concat_ws(dl, CAST(doc_id AS VARCHAR), lang, part)
                                      ELSE concat_ws(dl, CAST(doc_id AS VARCHAR), lang, CAST(n_chars AS VARCHAR), part) END
                            || CASE WHEN src % 3 = 1 AND i = max(i) OVER (PARTITION BY file, doc_id) THEN dl || CAST(n_chars % 10 AS VARCHAR) ELSE '' END, dl) AS f
  FROM raw
), vals AS (
  SELECT file, src, list_transform(f, lambda v: nullif(v, '')) AS f FROM unquoted WHERE len(f) <= 4 AND f <> ['']
  UNION ALL
  SELECT file, src, CASE WHEN src % 3 = 1 THEN [CAST(doc_id AS VARCHAR), lang, text, CAST(n_chars % 10 AS VARCHAR)]
                         ELSE [CAST(doc_id AS VARCHAR), lang, CAST(n_chars AS VARCHAR), text] END
  FROM docs WHERE src % 5 <> 4
)
SELECT f[1] AS doc_id, f[2] AS lang, CASE WHEN src % 3 = 1 THEN '' ELSE f[3] END AS n_chars,
       CASE WHEN src % 3 = 1 THEN f[3] ELSE f[4] END AS text, CASE WHEN src % 3 = 1 THEN f[4] END AS score, file AS source_file
FROM vals"""


@register("union_normalised", _UNION_SQL)
def q_union_normalised(spark, sf):
    """P1-P5 + F5 + U1 over the document files."""
    return au.union_normalised(document_files(spark, sf)).drop("split", "blk", "ord")


def _event_jsonl(spark, sf):
    e = _events(spark, sf)
    k = F.get_json_object("props", "$.k")
    line = (F.when(F.pmod("event_id", F.lit(10)) == 0, F.lit(""))
            .when(F.pmod("event_id", F.lit(10)) == 1, F.lit("{bad"))
            .when(F.pmod("event_id", F.lit(10)) == 2, F.col("user_id").cast("string"))
            .otherwise(F.concat(F.lit('{"k": '), k, F.lit(', "Event Type": "'), F.col("event_type"), F.lit('"}'))))
    return e.select(F.concat(F.lit("events_"), F.col("event_type"), F.lit(".jsonl")).alias("file"),
                    *line_place("event_id"), F.col("event_id").alias("ord"), line.alias("line"))


@register("json_lines", r"""
WITH l AS (
  SELECT 'events_' || event_type || '.jsonl' AS file, event_id AS ord,
         CASE event_id % 10 WHEN 0 THEN '' WHEN 1 THEN '{bad' WHEN 2 THEN CAST(user_id AS VARCHAR)
              ELSE '{"k": ' || json_extract_string(props, '$.k') || ', "Event Type": "' || event_type || '"}' END AS line
  FROM events
)
SELECT CASE WHEN json_type(line) = 'OBJECT' THEN json_extract_string(line, '$.k') END AS k,
       CASE WHEN json_type(line) = 'OBJECT' THEN json_extract_string(line, '$."Event Type"') END AS event_type,
       CASE WHEN json_type(line) <> 'OBJECT' THEN json_extract_string(line, '$') END AS value,
       file AS source_file
FROM l WHERE trim(line) <> '' AND json_valid(line)""")
def q_json_lines(spark, sf):
    return json_union(json_records(_event_jsonl(spark, sf)))

# ---------------------------------------------------------------- 3.3 benchmark pipeline
from .benchmark import benchmark_run_log  # noqa: E402


@register("rag_pipeline")
def q_rag_pipeline(spark, sf):
    """Grid x gold -> retrieval -> prompt -> generate -> grade -> groundedness (stand-in models)."""
    return benchmark_run_log(spark, sf)


@register("rag_pipeline_semantic")
def q_rag_pipeline_semantic(spark, sf):
    """The same run with semantic groundedness (cosine to the retrieved chunks, lexical fallback)."""
    return benchmark_run_log(spark, sf, groundedness="semantic")

# ---------------------------------------------------------------- U5 token Jaccard, contamination join
from ..functions import text as tx  # noqa: E402
from ..operators.contamination import contamination  # noqa: E402
from .oracle import norm as d_norm, toks as d_toks  # noqa: E402


@register("token_jaccard", with_run_log() + f""" SELECT pair_id,
  {_r('CAST(len(list_intersect(a, b)) AS DOUBLE) / greatest(len(list_distinct(list_concat(a, b))), 1)')} AS jaccard
  FROM (SELECT pair_id, list_distinct({d_toks(d_norm('predicted_answer'))}) AS a,
               list_distinct({d_toks(d_norm('gold_answer'))}) AS b FROM run_log)""")
def q_token_jaccard(spark, sf):
    d = run_log(spark, sf)
    return rp.round_doubles(d.select("pair_id", tx.jaccard_tokens_norm(tx.normalize_text("predicted_answer"),
                                                                        tx.normalize_text("gold_answer")).alias("jaccard")))


def _d_shingles(t: str) -> str:
    return (f"(CASE WHEN len({t}) >= 8 THEN list_transform(range(1, len({t}) - 6), lambda i: "
            f"array_to_string({t}[i:i + 7], ' ')) WHEN len({t}) > 0 THEN [array_to_string({t}, ' ')] "
            f"ELSE [] END)")


@register("contamination_join", f"""
WITH ds AS (SELECT DISTINCT doc_id, unnest({_d_shingles('t')}) AS shingle
            FROM (SELECT doc_id, {d_toks(d_norm('text'))} AS t FROM documents)),
bs AS (SELECT item_id, shingle, count(*) OVER (PARTITION BY item_id) AS n_item_shingles
       FROM (SELECT DISTINCT item_id, unnest({_d_shingles('t')}) AS shingle
             FROM (SELECT item_id, {d_toks(d_norm('text'))} AS t FROM benchmark)))
SELECT item_id, doc_id, count(*) AS shared, CAST(n_item_shingles AS INTEGER) AS n_item_shingles,
       {_r('count(*) / n_item_shingles')} AS containment
FROM ds JOIN bs USING (shingle) GROUP BY item_id, doc_id, n_item_shingles
HAVING count(*) / n_item_shingles >= 0.5""")
def q_contamination(spark, sf):
    return rp.round_doubles(contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark")))
