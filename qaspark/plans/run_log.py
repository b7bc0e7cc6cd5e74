"""The run-log fact table derived from the driver tables.

One row per (user turn, next assistant turn) of ``conversations``:

* question = the user turn, predicted_answer = the assistant turn that
  follows it (paired by an equi-join on ``(conv_id, turn + 1)``, so a long
  conversation spreads over many shuffle partitions instead of one window
  group);
* gold_answer = one of four variants chosen by ``(conv_id + turn) % 4``:
  the answer itself, the answer without its last word, the whole document
  ``doc_id = conv_id``, or two references ``document ||| answer without its
  first word``;
* language = the document's language, db_lang / llm / embedding / top_k /
  q_index10 are configuration columns derived from the ids;
* latencies, tokens and grades come from ``events`` at
  ``event_id = pair_id = conv_id * 100 + turn``;
* nulls are planted: predicted_answer at pair_id % 19 = 0, gold_answer at
  pair_id % 23 = 0, language at pair_id % 17 = 0.

``RUN_LOG_SQL`` is the same view in DuckDB SQL for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table

PAIR_ID_STRIDE = 100  # turns per conversation are below this stride
_WS = r"[ \t\n\r]"
_NWS = r"[^ \t\n\r]"
DROP_LAST_WORD = _WS + "*" + _NWS + "+" + _WS + r"*\z"
DROP_FIRST_WORD = r"\A" + _WS + "*" + _NWS + "+"

RUN_LOG_COLUMNS = [
    "pair_id", "conv_id", "turn", "db_lang", "q_index10", "question", "gold_answer", "predicted_answer",
    "language", "llm", "embedding", "top_k", "latency_total_ms", "latency_retrieval_ms",
    "latency_generation_ms", "prompt_tokens", "completion_tokens", "total_tokens", "tokens_per_sec",
    "gold_score_0_10", "gold_feedback", "factual_consistency_0_10", "hallucination_rate_0_1",
    "groundedness_pred_0_1", "retrieval_support_gold_0_1", "groundedness_mode_pred",
    "retrieval_support_mode_gold", "groundedness_requested",
]


def qa_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, question, answer): user turn joined to the next assistant turn."""
    conv = table(spark, sf_dir, "conversations")
    users = conv.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("question"))
    answers = conv.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return users.join(answers, ["conv_id", "turn"], "inner")


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = qa_pairs(spark, sf_dir).withColumn("pair_id", F.col("conv_id") * PAIR_ID_STRIDE + F.col("turn"))
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("conv_id"), F.col("text").alias("doc_text"), F.col("lang").alias("doc_lang"))
    ev = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("pair_id"), "value", "user_id", "event_type",
        F.get_json_object("props", "$.k").cast("double").alias("k"))
    j = p.join(docs, "conv_id", "left").join(ev, "pair_id", "left")

    variant = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(4))
    no_last = F.regexp_replace("answer", DROP_LAST_WORD, "")
    no_first = F.regexp_replace("answer", DROP_FIRST_WORD, "")
    gold = (F.when(F.pmod("pair_id", F.lit(23)) == 0, F.lit(None).cast("string"))
            .when(variant == 0, F.col("answer"))
            .when(variant == 1, no_last)
            .when(variant == 2, F.col("doc_text"))
            .otherwise(F.concat(F.col("doc_text"), F.lit(" ||| "), no_first)))
    pred = F.when(F.pmod("pair_id", F.lit(19)) == 0, F.lit(None).cast("string")).otherwise(F.col("answer"))
    top_k = F.when(F.pmod("turn", F.lit(4)) == 0, F.lit(3)).otherwise(F.lit(5))
    prompt_tokens = (F.coalesce(F.length("question"), F.lit(0)).cast("long") / 4).cast("long") + 40 * top_k
    completion_tokens = (F.coalesce(F.length(pred), F.lit(0)).cast("long") / 4).cast("long")
    factual = F.round(F.col("value") - 10.0 * F.floor(F.col("value") / 10.0), 2)
    return j.select(
        "pair_id", "conv_id", "turn",
        F.element_at(F.array(F.lit("es"), F.lit("en"), F.lit("ca")),
                     (F.pmod(F.floor(F.col("conv_id") / 2), F.lit(3)) + 1).cast("int")).alias("db_lang"),
        (F.pmod(F.col("conv_id") * 7 + F.col("turn"), F.lit(10)) + 1).cast("int").alias("q_index10"),
        F.col("question"),
        gold.alias("gold_answer"),
        pred.alias("predicted_answer"),
        F.when(F.pmod("pair_id", F.lit(17)) == 0, F.lit(None).cast("string"))
         .otherwise(F.col("doc_lang")).alias("language"),
        F.concat(F.lit("m"), F.pmod("conv_id", F.lit(3)).cast("string")).alias("llm"),
        F.concat(F.lit("e"), F.pmod(F.floor(F.col("conv_id") / 3), F.lit(3)).cast("string")).alias("embedding"),
        top_k.cast("int").alias("top_k"),
        F.round(F.col("k") * 25.0 + F.col("value") * 1000.0, 2).alias("latency_total_ms"),
        F.round(F.col("k") * 25.0, 2).alias("latency_retrieval_ms"),
        F.round(F.col("value") * 1000.0, 2).alias("latency_generation_ms"),
        prompt_tokens.cast("long").alias("prompt_tokens"),
        completion_tokens.cast("long").alias("completion_tokens"),
        (prompt_tokens + completion_tokens).cast("long").alias("total_tokens"),
        F.when(F.col("value") > 0, F.round(completion_tokens / F.col("value"), 2))
         .otherwise(F.lit(0.0)).alias("tokens_per_sec"),
        F.round(F.col("value") / 5.0, 2).alias("gold_score_0_10"),
        F.concat(F.lit("auto "), F.col("event_type")).alias("gold_feedback"),
        factual.alias("factual_consistency_0_10"),
        F.round(1.0 - factual / 10.0, 3).alias("hallucination_rate_0_1"),
        F.round(factual / 10.0, 3).alias("groundedness_pred_0_1"),
        F.round(F.pmod("user_id", F.lit(100)) / 100.0, 3).alias("retrieval_support_gold_0_1"),
        F.lit("lexical").alias("groundedness_mode_pred"),
        F.lit("lexical").alias("retrieval_support_mode_gold"),
        F.lit("lexical").alias("groundedness_requested"),
    )


# The same view for DuckDB.  Integer division and modulo are written so that
# both engines agree on non-negative ids.
RUN_LOG_SQL = r"""
run_log AS (
  WITH p AS (
    SELECT u.conv_id, u.turn, u.text AS question, a.text AS answer,
           u.conv_id * 100 + u.turn AS pair_id
    FROM conversations u
    JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
    WHERE u.role = 'user' AND a.role = 'assistant'
  ), j AS (
    SELECT p.*, d.text AS doc_text, d.lang AS doc_lang, e.value, e.user_id, e.event_type,
           CAST(json_extract_string(e.props, '$.k') AS DOUBLE) AS k,
           (p.conv_id + p.turn) % 4 AS variant,
           regexp_replace(p.answer, '[ \t\n\r]*[^ \t\n\r]+[ \t\n\r]*\z', '') AS no_last,
           regexp_replace(p.answer, '\A[ \t\n\r]*[^ \t\n\r]+', '') AS no_first,
           CASE WHEN p.pair_id % 19 = 0 THEN NULL ELSE p.answer END AS pred,
           CASE WHEN p.turn % 4 = 0 THEN 3 ELSE 5 END AS top_k_,
           round(e.value - 10.0 * floor(e.value / 10.0), 2) AS factual
    FROM p
    LEFT JOIN documents d ON d.doc_id = p.conv_id
    LEFT JOIN events e ON e.event_id = p.pair_id
  ), t AS (
    SELECT j.*,
           CAST(coalesce(length(question), 0) // 4 + 40 * top_k_ AS BIGINT) AS prompt_tok,
           CAST(coalesce(length(pred), 0) // 4 AS BIGINT) AS comp_tok
    FROM j
  )
  SELECT pair_id, conv_id, turn,
         (['es', 'en', 'ca'])[((conv_id // 2) % 3) + 1] AS db_lang,
         CAST((conv_id * 7 + turn) % 10 + 1 AS INTEGER) AS q_index10,
         question,
         CASE WHEN pair_id % 23 = 0 THEN NULL
              WHEN variant = 0 THEN answer
              WHEN variant = 1 THEN no_last
              WHEN variant = 2 THEN doc_text
              ELSE doc_text || ' ||| ' || no_first END AS gold_answer,
         pred AS predicted_answer,
         CASE WHEN pair_id % 17 = 0 THEN NULL ELSE doc_lang END AS language,
         'm' || CAST(conv_id % 3 AS VARCHAR) AS llm,
         'e' || CAST((conv_id // 3) % 3 AS VARCHAR) AS embedding,
         CAST(top_k_ AS INTEGER) AS top_k,
         round(k * 25.0 + value * 1000.0, 2) AS latency_total_ms,
         round(k * 25.0, 2) AS latency_retrieval_ms,
         round(value * 1000.0, 2) AS latency_generation_ms,
         prompt_tok AS prompt_tokens,
         comp_tok AS completion_tokens,
         prompt_tok + comp_tok AS total_tokens,
         CASE WHEN value > 0 THEN round(comp_tok / value, 2) ELSE 0.0 END AS tokens_per_sec,
         round(value / 5.0, 2) AS gold_score_0_10,
         'auto ' || event_type AS gold_feedback,
         factual AS factual_consistency_0_10,
         round(1.0 - factual / 10.0, 3) AS hallucination_rate_0_1,
         round(factual / 10.0, 3) AS groundedness_pred_0_1,
         round((user_id % 100) / 100.0, 3) AS retrieval_support_gold_0_1,
         'lexical' AS groundedness_mode_pred,
         'lexical' AS retrieval_support_mode_gold,
         'lexical' AS groundedness_requested
  FROM t
)"""
