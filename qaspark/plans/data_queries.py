"""Catalog entries for prompts, records, snippets, unions and coercions over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as cl
from ..functions import grounding as gr
from ..functions import responses as rs
from ..functions import text as tx
from ..operators import audit as au
from ..operators import reports as rp
from ..operators import retrieval as rt
from ..sources.tables import table
from .catalog import _r, register
from .more_queries import _CTX_SQL, _DOC_FILES_SQL, _TOPK_CTE, _UNION_SQL, _emb_topk, document_files, run_log_with_context
from .oracle import lexical_cols, refs, with_run_log
from .run_log import run_log


def _q(s: str) -> str:
    """A DuckDB string literal."""
    return "'" + s.replace("'", "''") + "'"


def _by_lang_sql(texts: dict[str, str], lang: str) -> str:
    cases = " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in texts.items())
    return f"CASE {lang} {cases} ELSE {_q(texts[rs.DEFAULT_PROMPT_LANG])} END"


# ---------------------------------------------------------------- R3/A11 prompts
_NAME_SQL = "d.source || '_' || CAST(d.doc_id AS VARCHAR) || '.txt'"


@register("prompt_build", with_run_log(_TOPK_CTE.strip(), f"""ctx AS (
  SELECT t.query_id, string_agg('[Fuente: ' || {_NAME_SQL} || ']' || chr(10) || coalesce(d.text, ''), chr(10) || chr(10) ORDER BY t.rank) AS blocks
  FROM topk t JOIN documents d ON d.doc_id = t.doc_id GROUP BY t.query_id)""") + f"""
SELECT r.pair_id, {_by_lang_sql(rs.PROMPT_INSTRUCTIONS, 'r.language')} || chr(10) || {_q(rs.CONTEXT_HEADER)} || chr(10) || coalesce(c.blocks, '')
       || chr(10) || {_q(rs.QUESTION_HEADER)} || chr(10) || coalesce(r.question, '') || chr(10) || {_q(rs.ANSWER_HEADER)} || chr(10) AS prompt
FROM run_log r LEFT JOIN ctx c ON c.query_id = r.conv_id""")
def q_prompt_build(spark, sf):
    """Each question with the documents of the three vectors nearest to its conversation's."""
    docs = table(spark, sf, "documents").withColumn("file", F.concat("source", F.lit("_"), F.col("doc_id").cast("string"), F.lit(".txt")))
    ctx = rt.assemble_context(_emb_topk(spark, sf), docs, ["query_id"], "doc_id", "text", "file").withColumnRenamed("query_id", "conv_id")
    d = run_log(spark, sf).select("pair_id", "conv_id", "question", "language").join(ctx, "conv_id", "left")
    none = F.array().cast("array<string>")
    return d.select("pair_id", rs.build_prompt("question", F.coalesce("ctx_names", none), F.coalesce("ctx_texts", none), "language").alias("prompt"))


def _grade_sql() -> str:
    part = [_by_lang_sql({k: v.split("%s")[i] for k, v in rs.GRADE_PROMPTS.items()}, "language") for i in range(4)]
    texts = [f"coalesce({c}, '')" for c in ("question", "predicted_answer", "gold_answer")]
    return f"{part[0]} || {texts[0]} || {part[1]} || {texts[1]} || {part[2]} || {texts[2]} || {part[3]}"


@register("grade_prompt", with_run_log() + f" SELECT pair_id, {_grade_sql()} AS prompt FROM run_log")
def q_grade_prompt(spark, sf):
    return run_log(spark, sf).select("pair_id", rs.grade_prompt("question", "predicted_answer", "gold_answer", "language").alias("prompt"))


# ---------------------------------------------------------------- R11/P17/P18 records and snippets
@register("record_documents", f"""
SELECT doc_id, printf('s01e%02d.txt', doc_id) AS file,
       {" || ".join(f"{_q(label + ': ')} || {value} || chr(10)" for label, value in zip(cl.RECORD_LABELS, ("coalesce(source, '')", "'1'", "CAST(doc_id AS VARCHAR)", "coalesce(text, '')", "coalesce(lang, '')")))} AS record
FROM documents""")
def q_record_documents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", cl.episode_file("doc_id").alias("file"), cl.record_text("source", "doc_id", "text", "lang").alias("record"))


@register("source_snippets", rf"""
SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN '{cl.UNKNOWN_SOURCE}' ELSE source END AS file,
       substr(regexp_replace(text, '^\s+|\s+$', '', 'g'), 1, {cl.SNIPPET_CHARS}) AS snippet FROM documents""")
def q_source_snippets(spark, sf):
    """Every seventh document has no file name."""
    s = cl.source_snippet("text", F.when(F.col("doc_id") % 7 != 0, F.col("source")))
    return table(spark, sf, "documents").select("doc_id", s["file"].alias("file"), s["text"].alias("snippet"))


# ---------------------------------------------------------------- P4/U2, S6/P9/O4 unions
@register("preferred_order", with_run_log() + """ SELECT question, prompt_tokens, completion_tokens, total_tokens, conv_id, gold_answer, language, llm, pair_id
FROM run_log""")
def q_preferred_order(spark, sf):
    """Known names first, the rest by name: the order of the columns is what this one is about."""
    d = run_log(spark, sf).select("pair_id", "total_tokens", "conv_id", "question", "llm", "completion_tokens", "language", "gold_answer", "prompt_tokens")
    return cl.preferred_order(d)


@register("bench_union", _UNION_SQL.replace("SELECT f[1] AS doc_id", r"SELECT regexp_extract(file, '^bench_out_([^/]*)/', 1) AS db_lang, f[1] AS doc_id", 1))
def q_bench_union(spark, sf):
    """The union of the document files with the language of each path first."""
    t = au.union_normalised(document_files(spark, sf)).drop("split", "blk", "ord")
    return t.select(cl.lang_from_path("source_file").alias("db_lang"), *t.columns)


# ---------------------------------------------------------------- T9, P6
_REF_FORMS = ["source || ' ||| ' || lang", "'[\"' || source || '\", \"' || lang || '\"]'", "'[]'", "'[bad ' || lang", "'|||'", "NULL", "source"]


@register("refs_list", f"""
WITH g AS (SELECT doc_id, CASE doc_id % 7 {" ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(_REF_FORMS))} END AS gold FROM documents)
SELECT doc_id, len({refs('gold')}) AS n_refs, array_to_string({refs('gold')}, '~') AS refs FROM g""")
def q_refs_list(spark, sf):
    """All forms of a reference: parts, a list, an empty list, a broken one, separators alone, null, one text."""
    gold = F.expr(f"CASE doc_id % 7 {' '.join(f'WHEN {i} THEN {x}' for i, x in enumerate(_REF_FORMS))} END")
    d = table(spark, sf, "documents").select("doc_id", tx.parse_refs(gold).alias("r"))
    return d.select("doc_id", F.size("r").cast("long").alias("n_refs"), F.array_join("r", "~").alias("refs"))


_CELLS = ["CAST(event_id AS STRING)", "concat(' ', CAST(event_id AS STRING), '.50 ')", "concat(CAST(event_id AS STRING), 'e2')", "'x'", "''", "'nan'", "concat(CAST(event_id AS STRING), 'd')",
          "NULL", "concat('-.', CAST(event_id AS STRING))", "'inf'"]


@register("numeric_coercion", f"""
WITH c AS (SELECT event_id, CASE event_id % 10 {" ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(_CELLS))} END AS cell FROM events),
v AS (SELECT event_id, CASE WHEN regexp_matches(lower(cell), '{cl.NUMERIC_TEXT}') THEN TRY_CAST(trim(cell) AS DOUBLE) END AS v FROM c)
SELECT event_id, CASE WHEN isinf(v) THEN 'inf' ELSE 'finite' END AS kind, CASE WHEN isinf(v) OR isnan(v) THEN NULL ELSE {_r('v')} END AS v
FROM v WHERE v IS NOT NULL AND NOT isnan(v)""")
def q_numeric_coercion(spark, sf):
    """Text cells that are numbers, and some that are not, which become null and are left out."""
    cell = F.expr(f"CASE event_id % 10 {' '.join(f'WHEN {i} THEN {x}' for i, x in enumerate(_CELLS))} END")
    d = table(spark, sf, "events").select("event_id", cl.safe_double(cell).alias("v")).where("v is not null")
    infinite = F.abs("v") == float("inf")
    return rp.round_doubles(d.select("event_id", F.when(infinite, "inf").otherwise("finite").alias("kind"), F.when(~infinite, F.col("v")).alias("v")))


# ---------------------------------------------------------------- G5/G6
@register("grounded_fallback", with_run_log(_CTX_SQL) + f"""
SELECT pair_id, CASE WHEN blank THEN 0.0 WHEN sim IS NULL THEN gp.f ELSE {_r('10.0 * s', 2)} END AS factual_consistency_0_10,
       CASE WHEN blank THEN 1.0 WHEN sim IS NULL THEN gp.h ELSE {_r('1.0 - s', 3)} END AS hallucination_rate_0_1,
       CASE WHEN blank THEN '' WHEN sim IS NULL THEN 'lexical_fallback' ELSE 'semantic' END AS mode
FROM (SELECT *, least(1.0, greatest(0.0, (sim + 1.0) / 2.0)) AS s FROM (
  SELECT pair_id, coalesce(predicted_answer, '') = '' OR coalesce(context, '') = '' AS blank,
         CASE WHEN pair_id % 3 <> 0 THEN retrieval_support_gold_0_1 * 2.0 - 1.0 END AS sim,
         {lexical_cols('predicted_answer', 'context', 'language', 'gp')} FROM rc))""")
def q_grounded_fallback(spark, sf):
    """Semantic support where a similarity is known (two of three rows), else lexical."""
    sim = F.when(F.col("pair_id") % 3 != 0, F.col("retrieval_support_gold_0_1") * 2.0 - 1.0)
    d = run_log_with_context(spark, sf).select("pair_id", gr.grounded("predicted_answer", "context", "language", sim).alias("g"))
    return d.select("pair_id", "g.factual_consistency_0_10", "g.hallucination_rate_0_1", "g.mode")
