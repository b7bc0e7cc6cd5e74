"""3.2: result files -> one normalised table + per-file audit, written once."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.audit import audit_listing, file_audit, union_normalised
from ..sinks.writers import write_table
from ..sources.files import json_records, json_union, list_files, scan_lines


def aggregate_with_audit(spark: SparkSession, input_dir: str, output_dir: str | None = None,
                         canonical: list[str] | None = None, fmt: str = "parquet",
                         fallback_encoding: str | None = "iso-8859-1") -> tuple[DataFrame, DataFrame]:
    """Union every CSV/TSV/JSONL under ``input_dir`` and audit each file, empty and unreadable ones too.

    An output folder under the input folder is excluded from the scan
    (Q11), so a second run never ingests its own output.
    """
    exclude = None
    if output_dir and os.path.abspath(output_dir).startswith(os.path.abspath(input_dir).rstrip("/") + "/"):
        exclude = os.path.relpath(output_dir, input_dir)
    lines = scan_lines(spark, input_dir, exclude=exclude)
    table = union_normalised(lines, canonical, fallback_encoding=fallback_encoding).drop("split", "blk", "ord")
    audit = audit_listing(list_files(spark, input_dir, exclude=exclude), file_audit(lines, canonical, fallback_encoding=fallback_encoding))
    jl = scan_lines(spark, input_dir, "*.{jsonl,ndjson}", exclude=exclude)
    if jl.limit(1).count():
        table = table.unionByName(json_union(json_records(jl)), allowMissingColumns=True)
        table = table.select(*[c for c in table.columns if c != "source_file"], "source_file")
    if output_dir:
        write_table(table, f"{output_dir}/aggregate", fmt)
        write_table(audit, f"{output_dir}/audit", fmt)
    return table, audit


def union_bench_outputs(spark: SparkSession, roots: list[str], pattern: str = "*.csv",
                        keep_source_path: bool = False) -> DataFrame:
    """The multi-root union: S6 + S7 + P9 + U1 + O4.

    Every matching CSV under the roots (missing roots warned and skipped),
    ``db_lang`` from the path (``bench_out_xx`` folder, else the file-name
    tail) as the first column, columns aligned by name, rows stably ordered
    by db_lang, then file and line.
    """
    from ..functions.columns import lang_from_path
    from ..sources.files import scan_roots
    lines = scan_roots(spark, roots, pattern)
    lines = lines.withColumn("file", F.concat_ws("/", F.col("root"), F.col("file"))).drop("root")
    t = union_normalised(lines, None, provenance="source_path", fallback_encoding="iso-8859-1")
    t = t.withColumn("db_lang", lang_from_path("source_path"))
    cols = ["db_lang"] + [c for c in t.columns if c not in ("db_lang", "source_path", "split", "blk", "ord")]
    if keep_source_path:
        cols.append("source_path")
    return t.orderBy("db_lang", "source_path", "split", "blk", "ord").select(*cols)


def aggregate_results(spark: SparkSession, in_dir: str) -> tuple[DataFrame, DataFrame]:
    """The flat-folder union: S8 + P8 (``__file`` = base name) + U1, and A4
    (mean of the run-log metrics per llm, embedding, language, top_k)."""
    from ..functions.columns import safe_double
    from ..operators.reports import CONFIG_METRICS, config_means
    lines = scan_lines(spark, in_dir, "*.csv")
    t = union_normalised(lines, None, provenance="__file").drop("split", "blk", "ord")
    t = t.withColumn("__file", F.element_at(F.split("__file", "/"), -1))
    typed = t.select(*[safe_double(c).alias(c) if c in CONFIG_METRICS else F.col(c) for c in t.columns])
    keys = [k for k in ("llm", "embedding", "language", "top_k") if k in typed.columns]
    return t, config_means(typed, keys)


def publish_aggregate(table: DataFrame, root: str, order_by: list[str], fmt: str = "parquet", run_id: str | None = None) -> int:
    """K9: the aggregate sorted by db_lang (``aggregate``), its means by configuration (``aggregate_grouped``) and the copy with a question index
    (``aggregate_with_questions``), published together as one version; its number.

    ``order_by``: the order of the rows within the table, which the index counts in.  If one of the three fails, readers keep all of the version before.
    """
    from ..functions.columns import safe_double
    from ..operators.positions import question_index_block, with_row_position
    from ..operators.reports import CONFIG_METRICS, config_means
    from ..sinks.publish import Published
    columns, types = table.columns, dict(table.dtypes)
    numbers = table.select(*[safe_double(c, types[c]).alias(c) if c in CONFIG_METRICS and types[c] == "string" else F.col(c) for c in columns])
    keys = [k for k in ("llm", "embedding", "language", "top_k") if k in columns]
    first = [c for c in ("db_lang",) if c in columns]
    numbered = with_row_position(table, [*first, *order_by], name="_row").withColumn("q_index10", question_index_block("_row"))
    indexed = numbered.select(*columns, *([] if "q_index10" in columns else ["q_index10"]))
    return Published(table.sparkSession, root).publish({
        "aggregate": table.orderBy(*first, *order_by), "aggregate_grouped": config_means(numbers, keys), "aggregate_with_questions": indexed}, fmt, run_id)
