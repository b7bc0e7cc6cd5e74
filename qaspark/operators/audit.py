"""Delimited records -> normalised union + per-file audit.

Input is a *line table* ``(file, split, blk, ord, line)`` (see ``operators.records``): one row per physical
line (what ``sources.files.scan_lines`` produces, or any
DataFrame built the same way).  Nothing is read whole, and no window spans a file.  A first pass finds the facts of each file, a row
each: its header (the first line of split 0), whether all its bytes are UTF-8, whether a record may span lines.  The
second pass decodes the lines by their file's verdict and makes records of them.

Delimiter: the candidate (``, ; TAB |``) occurring most often in the
header, ties in that order, comma when none occurs.  Field count is
quote-aware: quoted fields are masked before splitting, and a quoted
field may span lines (``operators.records``).  Values are
parsed with Spark's CSV parser (``from_csv``) using the file's delimiter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import norm_col_expr
from .partitioning import materialize
from .records import DELIMITERS, by_delimiter, masked, may_open, stitch

# The audit's example limits.
EXAMPLES_PER_FILE = 3
EXAMPLE_CHARS = 200
EXAMPLE_SEPARATOR = " || "
BOM = "﻿"


def sniff_delimiter(header) -> Column:
    """Most frequent candidate in the header line (ties in list order), else ','."""
    header = F.col(header) if isinstance(header, str) else header

    def times(d: str) -> Column:
        h = masked(header, F.lit(d))
        return F.length(h) - F.length(F.replace(h, F.lit(d), F.lit("")))
    counts = [F.struct(times(d).alias("n"),
                       F.lit(-i).alias("p"), F.lit(d).alias("d")) for i, d in enumerate(DELIMITERS)]
    best = F.array_max(F.array(*counts))
    return F.when(best["n"] > 0, best["d"]).otherwise(F.lit(","))


def field_count(line, delim) -> Column:
    """Quote-aware number of fields; an empty record has none (like csv.reader)."""
    line = F.col(line) if isinstance(line, str) else line
    delim = F.col(delim) if isinstance(delim, str) else delim
    m = masked(line, delim)
    return F.when(line == "", F.lit(0)).otherwise(by_delimiter(delim, lambda p, _: F.size(F.split(m, p))))


def header_names(facts: DataFrame) -> tuple[list[str], int]:
    """(names of the first file by path, then those that others add in order of their first file; the widest header's width): one small row a file, schema only."""
    meta = facts.orderBy("file").select("names").collect()
    seen = dict.fromkeys(n for r in meta for n in r["names"])
    return list(seen), max((len(r["names"]) for r in meta), default=1)


def split_fields(line: Column, delim: Column, n: int) -> Column:
    """Fields via Spark's CSV parser (quoted fields, doubled quotes inside them).

    A backslash is taken away first: before a quote it becomes a doubled quote, before anything else it goes.
    """
    line = F.regexp_replace(F.replace(line, F.lit('\\"'), F.lit('""')), r"\\(.)", "$1")
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(max(n, 1))])
    opts = {"quote": '"', "escape": '"', "nullValue": "\u0000", "emptyValue": "", "mode": "PERMISSIVE", "maxCharsPerColumn": "-1", "lineSep": "\u0002"}
    out = None
    for d in DELIMITERS:
        parsed = F.from_csv(line, schema.simpleString(), {**opts, "sep": d})
        # the record is parsed once, not for each of its fields
        arr = F.transform(F.array(parsed), lambda p: F.array(*[p[f"c{i}"] for i in range(max(n, 1))]))[0]
        out = (F.when(delim == d, arr) if out is None else out.when(delim == d, arr))
    return out


#: What 0x80 to 0x9F are in windows-1252, the others of its upper half being those of ISO-8859-1; five are no characters and stay control codes.
_C1 = "".join(map(chr, range(0x80, 0xA0)))
_CP1252 = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(0x80, 0xA0))
ENCODINGS = ("cp1252", "iso-8859-1")


def decoded(line, utf8, encoding: str | None) -> Column:
    """A line's bytes as text: UTF-8 where its whole file is (``utf8``), else in the fallback ``encoding``, byte by byte."""
    line = F.col(line) if isinstance(line, str) else line
    if encoding is None:
        return line
    if encoding not in ENCODINGS:
        raise ValueError(f"the fallback encoding must be one of {ENCODINGS}")
    text = F.decode(line.cast("binary"), "ISO-8859-1")
    return F.when(utf8, line).otherwise(F.translate(text, _C1, _CP1252) if encoding == "cp1252" else text)


def file_facts(lines: DataFrame, fallback_encoding: str | None = None, sep: str | None = None, normalise: bool = True) -> DataFrame:
    """(file, utf8, spans, n_lines, header, header_ord, delimiter, n_header, names array<string>): one row per file.

    One pass over the lines, written once (a small row per file).  utf8: whether all bytes of the file are valid; spans: whether a
    line may leave a quoted field open.  ``sep``: the delimiter of all files; ``normalise``: names by ``norm_col``, else only trimmed.
    """
    first = F.col("split") == 0
    raw = F.col("line")
    facts = lines.groupBy("file").agg(
        F.min(F.is_valid_utf8(raw)).alias("utf8"), F.max(may_open(raw)).alias("spans"), F.count("*").alias("n_lines"),
        F.min_by(F.when(first, raw), F.when(first, F.struct("blk", "ord"))).alias("header"), F.min(F.when(first, F.struct("blk", "ord"))).alias("header_ord"))
    facts = facts.withColumn("header", F.regexp_replace(decoded("header", F.col("utf8"), fallback_encoding), "^" + BOM, ""))
    facts = facts.withColumn("delimiter", F.lit(sep) if sep else sniff_delimiter("header"))
    facts = materialize(facts.withColumn("n_header", field_count("header", "delimiter")))
    max_n = facts.agg(F.max("n_header")).first()[0] or 1   # schema-level: widest header
    names = split_fields(F.col("header"), F.col("delimiter"), max_n)
    facts = facts.withColumn("names", F.transform(F.slice(names, 1, F.col("n_header")), norm_col_expr if normalise else F.trim))
    return facts.withColumn("names", dedupe_names("names"))


def dedupe_names(names) -> Column:
    """Q9: a name that is taken already gets the first free _2, _3 ...; all names differ at the end."""
    given = F.col(names) if isinstance(names, str) else names

    def add(out, x):
        made = F.transform(F.sequence(F.lit(2), F.size(given) + 1), lambda k: F.concat(x, F.lit("_"), k.cast("string")))
        free = F.filter(made, lambda m: ~F.array_contains(out, m) & ~F.array_contains(given, m))
        return F.concat(out, F.array(F.when(F.array_contains(out, x), F.get(free, F.lit(0))).otherwise(x)))
    return F.aggregate(given, F.array().cast("array<string>"), add)


def records(lines: DataFrame, facts: DataFrame, fallback_encoding: str | None = None) -> DataFrame:
    """Data records (header removed) with their file's delimiter and field count; ``line`` holds the whole record, ``closed`` is as in ``records.stitch``."""
    # one row a file; the optimizer broadcasts it when its size allows
    r = lines.join(facts.select("file", "utf8", "spans", "delimiter", "n_header", "names", "header_ord"), "file")
    r = r.where(~((F.col("split") == 0) & (F.struct("blk", "ord") == F.col("header_ord")))).drop("header_ord")
    r = r.withColumn("line", decoded("line", F.col("utf8"), fallback_encoding)).drop("utf8")
    r = stitch(r, F.col("spans")).drop("spans")
    return r.withColumn("n_fields", field_count("line", "delimiter"))


def file_audit(lines: DataFrame, expected: list[str] | None = None, provenance: str = "source_file",
               fallback_encoding: str | None = None) -> DataFrame:
    """A7 + A8 per file: delimiter, data rows, bad rows, first bad examples, column audit.

    Expected columns: the canonical list, else the first file's (lowest
    path) header.  Missing columns are computed before any filling and
    exclude the provenance column (Q10).  A record whose quote is never closed is a bad row.

    Records are made once: what the counts and examples need of them is written.
    """
    hdr = file_facts(lines, fallback_encoding)
    bad = (F.col("n_fields") != F.col("n_header")) | ~F.col("closed")
    example = F.substring(F.regexp_replace("line", "\t|;|\\|", ","), 1, EXAMPLE_CHARS)
    rec = records(lines, hdr, fallback_encoding).select("file", "split", "blk", "ord", bad.alias("bad"), F.when(bad, example).alias("example"))
    rec = materialize(rec)
    # the first of each block, of these the first of each split, of these the first of the file: at most three a split meet
    ex = rec.where("bad")
    for by, order in ((["file", "split", "blk"], ["ord"]), (["file", "split"], ["blk", "ord"])):
        ex = ex.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_rn") <= EXAMPLES_PER_FILE)
    ex = ex.groupBy("file").agg(F.slice(F.array_sort(F.collect_list(F.struct("split", "blk", "ord", "example"))), 1, EXAMPLES_PER_FILE).alias("e"))
    ex = ex.select("file", F.array_join("e.example", EXAMPLE_SEPARATOR).alias("bad_examples"))
    counts = rec.groupBy("file").agg(F.count(F.lit(1)).alias("n_rows_data"), F.count_if("bad").alias("n_bad_rows_parse"))
    if expected is None:
        first = hdr.orderBy("file").select("names").first()
        expected = list(first[0]) if first else []
    exp = F.array(*[F.lit(c) for c in expected]) if expected else F.array().cast("array<string>")
    out = (hdr.join(counts, "file", "left").join(ex, "file", "left")
           .select("file", "delimiter",
                   F.coalesce("n_rows_data", F.lit(0)).alias("n_rows_data"),
                   F.coalesce("n_bad_rows_parse", F.lit(0)).alias("n_bad_rows_parse"),
                   F.size(F.array_distinct(exp)).alias("cols_expected_count"),
                   F.size(F.array_distinct("names")).alias("cols_found_count"),
                   F.array_join(F.array_sort(F.array_except(exp, F.col("names"))), "|").alias("cols_missing"),
                   F.coalesce("bad_examples", F.lit("")).alias("bad_examples")))
    return out


def audit_listing(listing: DataFrame, audit: DataFrame) -> DataFrame:
    """the audit with a row for every listed file (file, length), and its ``status``.

    ``ok``; ``no rows``: a header alone; ``empty``: no byte; ``unreadable``: bytes, but no line could be read.  The counts of the last two are 0, their
    other columns null.  A file that is audited but not listed keeps its row.
    """
    status = (F.when(F.col("delimiter").isNotNull(), F.when(F.col("n_rows_data") > 0, "ok").otherwise("no rows"))
              .when(F.col("length") == 0, "empty").otherwise("unreadable"))
    rows = listing.select("file", "length").join(audit, "file", "full")
    counts = ("n_rows_data", "n_bad_rows_parse")
    return rows.select("file", status.alias("status"), *[F.coalesce(c, F.lit(0)).alias(c) if c in counts else F.col(c) for c in audit.columns if c != "file"])


def union_normalised(lines: DataFrame, canonical: list[str] | None = None, provenance: str = "source_file",
                     skip_long_rows: bool = True, fallback_encoding: str | None = None) -> DataFrame:
    """S3 + P1-P5 + U1: every file's records under one string schema.

    Canonical columns first (absent ones filled with ""), then the extra
    columns in first-seen order (files by path), then the provenance.
    Rows with more fields than their header are skipped (F5); short rows
    leave null.  Blank lines are not records.
    """
    hdr = file_facts(lines, fallback_encoding)
    seen, max_n = header_names(hdr)
    first = hdr.orderBy("file").select("names").first()
    base = list(canonical) if canonical is not None else (list(first["names"]) if first else [])
    # a data column named like the provenance column is overwritten by it
    base = [c for c in base if c != provenance]
    extras = [c for c in seen if c not in base and c != provenance]
    rec = records(lines, hdr, fallback_encoding).where(F.col("line") != "")
    if skip_long_rows:
        rec = rec.where(F.col("n_fields") <= F.col("n_header"))
    rec = rec.withColumn("_vals", split_fields(F.col("line"), F.col("delimiter"), max_n))
    rec = rec.withColumn("_m", F.map_from_arrays("names", F.slice("_vals", 1, F.size("names"))))
    # a column the file lacks is "" (P2); a short row leaves null
    cols = [F.when(F.array_contains("names", c), F.try_element_at("_m", F.lit(c))).otherwise(F.lit(""))
            .cast("string").alias(c) for c in base]
    cols += [F.try_element_at("_m", F.lit(c)).alias(c) for c in extras]
    return rec.select(*cols, F.col("file").alias(provenance), "split", "blk", "ord")
