"""File scans for corpora, gold sets and run-log files.

Scans are splittable and distributed: delimited files are read as lines
with their file path, split offset and in-split order (the header of a
file is its first line); JSON Lines are parsed strictly line by line.
"""

from __future__ import annotations

import os
import re
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.responses import parse_json_strict
from ..functions.columns import norm_col_expr

DELIMITED_GLOB = "*.{csv,tsv}"
JSONL_GLOB = "*.{jsonl,ndjson}"


def relative_path(path_col, root: str):
    """A file's path below ``root``; the name of a file that is itself the root."""
    root = os.path.abspath(root).rstrip("/").lstrip("/")
    below = F.regexp_replace(path_col, r"^(file:)?/*" + re.escape(root) + "/", "")
    return F.when(path_col.endswith("/" + root), F.element_at(F.split(path_col, "/"), -1)).otherwise(below)


def _children_except(spark: SparkSession, root: str, exclude: str) -> list[str]:
    """Paths directly under ``root`` except the one holding ``exclude`` (a listing, no data read)."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    top = exclude.strip("/").split("/")[0]
    return [st.getPath().toString() for st in fs.listStatus(path) if st.getPath().getName() != top]


#: Lines of a block of the line table, as a power of two.
BLOCK_LINES = 13
LINE_TABLE = "file string, split long, blk long, ord long, line string"


def line_blocks(scanned: DataFrame) -> DataFrame:
    """(file, split, line) with ``ord``, the order in which a task reads them, and ``blk``, its runs of 2**BLOCK_LINES lines."""
    d = scanned.withColumn("ord", F.monotonically_increasing_id())
    return d.withColumn("blk", F.shiftright(F.col("ord").bitwiseAND((1 << 33) - 1), BLOCK_LINES)).select("file", "split", "blk", "ord", "line")


def scan_lines(spark: SparkSession, root: str, glob: str = DELIMITED_GLOB, exclude: str | None = None,
               fallback_encoding: str | None = None) -> DataFrame:
    """Every line of every matching file under ``root`` (recursive), or of the file ``root``.

    Returns the line table (file relative to root, split, blk, ord, line; see ``operators.records``).  Lines hold their bytes as they are: whether a file is
    UTF-8, its bytes decide (``operators.audit.file_facts``, ``decode_lines``); with ``fallback_encoding`` lines are text, decoded so.  ``exclude`` (a path
    relative to root, e.g. the job's own output, Q11) is left out of the
    listing itself, so its files are never opened.  A file that cannot be read gives the lines before the damage; ``list_files`` and the audit tell of it.
    """
    paths = _children_except(spark, root, exclude) if exclude else [root]
    if not paths:
        return spark.createDataFrame([], LINE_TABLE)
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).option("ignoreCorruptFiles", "true")
    lines = line_blocks(reader.text(paths).select(relative_path(F.col("_metadata.file_path"), root).alias("file"),
                                                  F.col("_metadata.file_block_start").alias("split"), F.col("value").alias("line")))
    return decode_lines(lines, fallback_encoding).drop("utf8") if fallback_encoding else lines


def list_files(spark: SparkSession, root: str, glob: str = DELIMITED_GLOB, exclude: str | None = None) -> DataFrame:
    """(file relative to root, length) of every matching file, empty and unreadable ones too; no content is read."""
    paths = _children_except(spark, root, exclude) if exclude else [root]
    if not paths:
        return spark.createDataFrame([], "file string, length long")
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    # the scan leaves files of no byte out, the index that Spark makes of the folder names them
    named = spark.createDataFrame([(unquote(f),) for f in reader.text(paths).inputFiles()], "path string")
    files = reader.format("binaryFile").load(paths).select(relative_path(F.col("path"), root).alias("file"), "length")
    return named.select(relative_path(F.col("path"), root).alias("file")).join(files, "file", "left").select("file", F.coalesce("length", F.lit(0)).alias("length"))


def decode_lines(lines: DataFrame, fallback_encoding: str = "cp1252") -> DataFrame:
    """The line table with each line as text, and ``utf8``, whether all bytes of its file are UTF-8.

    One pass over the bytes gives a verdict for each file (a small table, written); it is joined back, and the lines of files that are not UTF-8 are
    decoded byte by byte.  No path goes through the driver, and no file is read by two readers.
    """
    from ..operators.audit import decoded
    from ..operators.partitioning import materialize
    verdict = materialize(lines.groupBy("file").agg(F.min(F.is_valid_utf8("line")).alias("utf8")))
    return lines.join(verdict, "file").withColumn("line", decoded("line", F.col("utf8"), fallback_encoding))


def scan_json_lines(spark: SparkSession, root: str, glob: str = JSONL_GLOB) -> DataFrame:
    """JSON Lines; blank and corrupt lines skipped, scalars wrapped as ``value``.

    Returns (file, split, blk, ord, fields map<string,string>) with normalised keys.
    """
    lines = scan_lines(spark, root, glob)
    return json_records(lines)


def json_records(lines: DataFrame) -> DataFrame:
    v = parse_json_strict(F.col("line"))
    is_obj = F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.lit(False))
    obj = F.from_json(F.to_json(v), "map<string,string>")
    scalar = F.create_map(F.lit("value"), F.try_variant_get(v, "$", "string"))
    m = F.when(is_obj, obj).otherwise(scalar)
    d = lines.where((F.trim("line") != "") & v.isNotNull()).select("file", "split", "blk", "ord", m.alias("_m"))
    return d.select("file", "split", "blk", "ord", F.transform_keys("_m", lambda k, _: norm_col_expr(k)).alias("fields"))


def json_union(recs: DataFrame, provenance: str = "source_file") -> DataFrame:
    """U1 over JSON records: columns in first-seen order (file, line), all strings."""
    keys = (recs.select("file", "split", "blk", "ord", F.posexplode(F.map_keys("fields")).alias("_p", "k"))
            .groupBy("k").agg(F.min(F.struct("file", "split", "blk", "ord", "_p")).alias("_first"))
            .orderBy("_first").select("k").collect())            # distinct column names only
    names = [r["k"] for r in keys]
    return recs.select(*[F.try_element_at("fields", F.lit(n)).alias(n) for n in names],
                       F.col("file").alias(provenance))


def read_corpus(spark: SparkSession, root: str, lang: str | None = None) -> DataFrame:
    """One document per file: (doc_id = path below root, file_name, lang, text)."""
    df = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").text(root)
    return df.select(relative_path(F.col("_metadata.file_path"), root).alias("doc_id"), F.col("_metadata.file_name").alias("file_name"),
                     F.lit(lang).cast("string").alias("lang"), F.col("value").alias("text"))


def read_delimited(lines: DataFrame, sep: str | None = None, fallback_encoding: str | None = "cp1252", required: set[str] = frozenset(),
                   normalise: bool = True) -> DataFrame:
    """Records of a line table as columns, named by the header of the first file by path, all strings; S2, S9 and S12 are this with their own names and types.

    Splittable, quoted fields over several lines included.  Columns are matched by name, what a file lacks is null, as is what a short record lacks; blank
    lines are no records.  ``sep``: the delimiter, else by the header; ``required``: raises if names are missing (F6).  With ``normalise`` False
    names are only trimmed.
    """
    from ..operators.audit import file_facts, header_names, records, split_fields
    facts = file_facts(lines, fallback_encoding, sep, normalise)
    names, widest = header_names(facts)
    if missing := set(required) - set(names):
        raise ValueError(f"columns are missing: {sorted(missing)}")
    rec = records(lines, facts, fallback_encoding).where(F.col("line") != "")
    rec = rec.withColumn("_vals", split_fields(F.col("line"), F.col("delimiter"), widest))
    rec = rec.withColumn("_m", F.map_from_arrays("names", F.slice("_vals", 1, F.size("names"))))
    return rec.select(*[F.try_element_at("_m", F.lit(c)).alias(c) for c in names])


def gold_set(table: DataFrame) -> DataFrame:
    """(q_index10, question, gold_answer, language) of a gold table of strings; what it lacks is null."""
    def column(name: str, kind: str):
        return (F.col(name).try_cast(kind) if name in table.columns else F.lit(None).cast(kind)).alias(name)

    return table.select(column("q_index10", "int"), "question", "gold_answer", column("language", "string"))


def read_gold(spark: SparkSession, path: str, encoding: str = "cp1252", sep: str | None = None) -> DataFrame:
    """Gold set (q_index10, question, gold_answer, language).

    UTF-8, with a BOM or not, else ``encoding`` (cp1252 or iso-8859-1); delimiter from the header when not given;
    required columns checked on the header before any record is read (F6).
    """
    return gold_set(read_delimited(scan_lines(spark, path, "*"), sep, encoding, {"question", "gold_answer"}))


def scan_roots(spark: SparkSession, roots: list[str], glob: str = "*.csv") -> DataFrame:
    """Lines of the matching files under several roots; a missing root is skipped with a warning."""
    import warnings
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    parts = []
    for r in roots:
        p = jvm.org.apache.hadoop.fs.Path(r)
        if not p.getFileSystem(conf).exists(p):
            warnings.warn(f"root does not exist: {r}")
            continue
        parts.append(scan_lines(spark, r, glob).withColumn("root", F.lit(r)))
    if not parts:
        raise FileNotFoundError("no readable root")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def load_canonical(spark: SparkSession, schema_json: str | None = None, schema_csv: str | None = None) -> list[str] | None:
    """Canonical column list from a JSON list file or a CSV header (names normalised)."""
    from ..functions.columns import norm_col
    if schema_json:
        import json
        txt = "\n".join(r[0] for r in spark.read.text(schema_json).collect())   # one small file
        data = json.loads(txt)
        return [norm_col(x) for x in data] if isinstance(data, list) else None
    if schema_csv:
        return [norm_col(c) for c in spark.read.option("header", "true").csv(schema_csv).columns]
    return None


#: The typed columns of a run log; the others are strings.
RUN_LOG_TYPES = {"q_index10": "int", "top_k": "int", "prompt_tokens": "long", "completion_tokens": "long", "total_tokens": "long"} | dict.fromkeys(
    ["latency_total_ms", "latency_retrieval_ms", "latency_generation_ms", "tokens_per_sec", "gold_score_0_10", "factual_consistency_0_10",
     "hallucination_rate_0_1", "groundedness_pred_0_1", "retrieval_support_gold_0_1"], "double")


def typed(table: DataFrame, types: dict[str, str] = RUN_LOG_TYPES) -> DataFrame:
    """The columns of a table of strings in their types; what is not a value of its type is null."""
    return table.select(*[F.col(f"`{c}`").try_cast(types[c]).alias(c) if c in types else F.col(f"`{c}`") for c in table.columns])


def read_run_log(spark: SparkSession, path: str, sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """A run-log CSV with a given separator and encoding, all strings; ``typed`` gives its columns their types.

    Types are never inferred, so one malformed cell does not change a column's type.  ``encoding``: UTF-8 (a BOM is dropped), or what a file that is not UTF-8 is read as
    (cp1252 or iso-8859-1).
    """
    fallback = None if encoding.lower().replace("_", "-") in ("utf-8", "utf8", "utf-8-sig") else {"latin-1": "iso-8859-1", "latin1": "iso-8859-1"}.get(encoding.lower(), encoding.lower())
    return read_delimited(scan_lines(spark, path, "*"), sep, fallback, normalise=False)
