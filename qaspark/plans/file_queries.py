"""Catalog entries for scans, audits, log pairing, the vector table and published outputs.

The given tables are no files; each query says what of them is taken as the lines or events that the operator works on.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as cl
from ..operators import audit as au
from ..operators import reports as rp
from ..operators.latency import paired_latencies
from ..operators.scoring import score_pairs
from ..operators.vector_table import VectorTable
from ..session import checkpoint_path
from ..sinks.publish import Published
from ..sinks.record_files import read_record_files, write_record_files
from ..sources.files import RUN_LOG_TYPES, decode_lines, read_delimited, typed
from ..sources.tables import table
from . import data_queries  # noqa: F401  registers what a twin here refers to
from .catalog import ORACLE, _r, register
from .ingest import publish_aggregate
from .more_queries import document_files, line_place
from .oracle import with_run_log
from .run_log import RUN_LOG_COLUMNS, run_log

# ---------------------------------------------------------------- S9/S12: the typed scan of a run log
_IDS = {"pair_id": "long", "conv_id": "long", "turn": "long"}


def run_log_lines(spark, sf):
    """The run log as the physical lines of CSV files, one for each db_lang: strings quoted, nulls as nothing; questions and answers may span lines."""
    d = run_log(spark, sf)
    quoted = {c: F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('""')), F.lit('"')) for c, t in d.dtypes if t == "string"}
    cells = [F.coalesce(quoted.get(c, F.col(c).cast("string")), F.lit("")) for c in RUN_LOG_COLUMNS]
    record = F.concat(*[x for i, c in enumerate(cells) for x in ([F.lit(",")] if i else []) + [c]])
    file = F.concat(F.lit("run_"), F.col("db_lang"), F.lit(".csv"))
    rows = d.select(file.alias("file"), *line_place("pair_id"), "pair_id", F.posexplode(F.split(record, "\n")).alias("i", "line"))
    rows = rows.select("file", "split", "blk", F.struct("pair_id", "i").alias("ord"), "line")
    heads = d.select(file.alias("file")).distinct().select(
        "file", F.lit(0).cast("long").alias("split"), F.lit(-1).cast("long").alias("blk"),
        F.struct(F.lit(-1).cast("long").alias("pair_id"), F.lit(0).alias("i")).alias("ord"), F.lit(",".join(RUN_LOG_COLUMNS)).alias("line"))
    return heads.unionByName(rows)


@register("run_log_scan", with_run_log() + f" SELECT {', '.join(RUN_LOG_COLUMNS)} FROM run_log")
def q_run_log_scan(spark, sf):
    """The run log, written as lines of CSV files, scanned back record by record and typed."""
    return typed(read_delimited(run_log_lines(spark, sf), fallback_encoding=None, normalise=False), RUN_LOG_TYPES | _IDS).select(*RUN_LOG_COLUMNS)


# ---------------------------------------------------------------- S2/S7: encodings
#: Of the characters that windows-1252 has and ISO-8859-1 lacks, some that texts have.
_OWN_1252 = "€…‘’“”•–—Œœ"


def encoded_lines(spark, sf):
    """The texts of documents as lines of one file for each language and source: UTF-8, or windows-1252 where the source's number is odd (what that lacks as ``?``)."""
    odd = F.pmod(F.regexp_extract("source", r"(\d+)$", 1).cast("int"), F.lit(2)) == 1
    c1 = "".join(chr(c.encode("cp1252")[0]) for c in _OWN_1252)
    narrow = F.translate(F.regexp_replace("text", rf"[^\x00-\x7F -ÿ{_OWN_1252}]", "?"), _OWN_1252, c1)
    d = table(spark, sf, "documents").select(F.concat_ws("/", "lang", "source").alias("file"), *line_place("doc_id"), "doc_id", odd.alias("odd"),
                                             F.posexplode(F.split(F.when(odd, narrow).otherwise(F.col("text")), "\n")).alias("i", "line"))
    raw = F.when(F.col("odd"), F.encode("line", "ISO-8859-1").cast("string")).otherwise(F.col("line"))
    return d.select("file", "split", "blk", F.struct("doc_id", "i").alias("ord"), raw.alias("line"))


@register("decoded_lines", rf"""
WITH d AS (SELECT doc_id, concat_ws('/', lang, source) AS file, CAST(regexp_extract(source, '(\d+)$', 1) AS INTEGER) % 2 = 1 AS odd, text FROM documents),
t AS (SELECT doc_id, file, odd, CASE WHEN odd THEN regexp_replace(text, '[^\x00-\x7F\x{{A0}}-\x{{FF}}{_OWN_1252}]', '?', 'g') ELSE text END AS text FROM d),
v AS (SELECT file, bool_and(NOT odd OR NOT regexp_matches(text, '[^\x00-\x7F]')) AS utf8 FROM t GROUP BY file),
l AS (SELECT doc_id, file, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM t)
SELECT doc_id, CAST(i AS INTEGER) AS line_no, utf8, CAST(length(line) AS INTEGER) AS n_chars, md5(line) AS digest FROM l JOIN v USING (file)""")
def q_decoded_lines(spark, sf):
    d = decode_lines(encoded_lines(spark, sf), "cp1252")
    return d.select(F.col("ord.doc_id").alias("doc_id"), (F.col("ord.i") + 1).alias("line_no"), "utf8", F.length("line").alias("n_chars"), F.md5("line").alias("digest"))


# ---------------------------------------------------------------- F3: files that give no line
@register("listing_audit", f"""
WITH audit AS ({ORACLE["file_audit"]}),
listing AS (SELECT DISTINCT 'bench_out_' || l || '/' || source || '.csv' AS file FROM documents, (SELECT DISTINCT coalesce(lang, 'none') AS l FROM documents UNION SELECT 'none'))
SELECT file, CASE WHEN delimiter IS NULL THEN 'empty' WHEN n_rows_data > 0 THEN 'ok' ELSE 'no rows' END AS status, delimiter, coalesce(n_rows_data, 0) AS n_rows_data,
       coalesce(n_bad_rows_parse, 0) AS n_bad_rows_parse, cols_expected_count, cols_found_count, cols_missing, bad_examples
FROM listing LEFT JOIN audit USING (file)""")
def q_listing_audit(spark, sf):
    """The audit of the document files with a row for each file of a listing, which has a file of no byte for each source too."""
    lines = document_files(spark, sf)
    d = table(spark, sf, "documents")
    langs = d.select(F.coalesce("lang", F.lit("none")).alias("l")).unionAll(spark.createDataFrame([("none",)], "l string")).distinct()
    names = d.select("source").distinct().crossJoin(langs).select(F.concat(F.lit("bench_out_"), F.col("l"), F.lit("/"), F.col("source"), F.lit(".csv")).alias("file"))
    lengths = lines.groupBy("file").agg(F.sum(F.octet_length("line") + 1).alias("length"))
    listing = names.join(lengths, "file", "left").select("file", F.coalesce("length", F.lit(0)).alias("length"))
    return au.audit_listing(listing, au.file_audit(lines))


# ---------------------------------------------------------------- P20/A6: a column that is null throughout
@register("tps_fallback", with_run_log() + f""" SELECT pair_id, {_r('CASE WHEN latency_generation_ms <> 0 THEN completion_tokens / (latency_generation_ms / 1000.0) END')} AS tokens_per_sec FROM run_log""")
def q_tps_fallback(spark, sf):
    """A run log whose tokens_per_sec is null in every row: it is derived from tokens and seconds."""
    d = run_log(spark, sf).withColumn("tokens_per_sec", F.lit(None).cast("double"))
    return rp.round_doubles(score_pairs(d).select("pair_id", "tokens_per_sec"))


# ---------------------------------------------------------------- R5: latencies of a log of starts and ends
@register("event_latencies", """
SELECT user_id, CASE WHEN p.event_type = 'view' THEN p.event_id END AS start_id, event_id AS end_id,
       CASE WHEN p.event_type = 'view' THEN (epoch_us(ts) - epoch_us(p.ts)) / 1000 END AS latency_ms
FROM (SELECT *, lag({'event_type': event_type, 'event_id': event_id, 'ts': ts}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p
      FROM events WHERE event_type IN ('view', 'purchase') AND user_id IS NOT NULL AND ts IS NOT NULL)
WHERE event_type = 'purchase'""")
def q_event_latencies(spark, sf):
    """Each purchase with the user's last view before it: end minus start."""
    e = table(spark, sf, "events")
    return paired_latencies(e, F.col("event_type") == "view", F.col("event_type") == "purchase").select("user_id", "start_id", "end_id", "latency_ms")


# ---------------------------------------------------------------- M2: a vector table over a corpus that changes
_MODELS = ["e0", "e1"]


@register("vector_table_versions", f"""
WITH a AS (SELECT doc_id, lang, sha256(coalesce(text, '')) AS digest FROM documents WHERE doc_id % 10 <> 0),
b AS (SELECT doc_id, lang, sha256(coalesce(text, '') || CASE WHEN doc_id % 10 = 2 THEN ' revised' ELSE '' END) AS digest FROM documents WHERE doc_id % 10 <> 1)
SELECT embedding, lang, doc_id, digest, CAST(CASE WHEN digest IN (SELECT digest FROM a) THEN 1 ELSE 2 END AS BIGINT) AS version, 64 AS dim
FROM b, (SELECT unnest({_MODELS}) AS embedding)""")
def q_vector_table_versions(spark, sf):
    """A corpus in two versions: in the second a tenth of the documents is new, a tenth gone and a tenth changed; the version in which each vector was made."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "text")
    vectors = VectorTable(spark, checkpoint_path(spark, "vector-table"), _MODELS)
    vectors.update(d.where("doc_id % 10 <> 0"))
    revised = F.when(F.col("doc_id") % 10 == 2, F.concat(F.coalesce("text", F.lit("")), F.lit(" revised"))).otherwise(F.col("text"))
    vectors.update(d.where("doc_id % 10 <> 1").withColumn("text", revised))
    return vectors.read().select("embedding", "lang", "doc_id", "digest", "version", F.size("vector").alias("dim"))


# ---------------------------------------------------------------- K6, K9: outputs read back
@register("record_files", "SELECT file AS name, record AS text FROM (" + ORACLE["record_documents"] + ")")
def q_record_files(spark, sf):
    """Each document's record in a file of its own, and the files read back."""
    d = table(spark, sf, "documents").select(cl.episode_file("doc_id").alias("file"), cl.record_text("source", "doc_id", "text", "lang").alias("record"))
    folder = checkpoint_path(spark, "record-files")
    write_record_files(d, folder, "file", "record")
    return read_record_files(spark, folder)


@register("published_summary", ORACLE["config_means"])
def q_published_summary(spark, sf):
    """The run log published as aggregate, grouped summary and indexed copy; the summary read through the commit."""
    root = checkpoint_path(spark, "published")
    publish_aggregate(run_log(spark, sf), root, ["pair_id"])
    return rp.round_doubles(Published(spark, root).read("aggregate_grouped"))
