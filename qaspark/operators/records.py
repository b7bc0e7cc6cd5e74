"""Records of delimited files from their physical lines (S3): a quoted field may span lines.

A *line table* has (file, split, blk, ord, line): ``split`` is the byte offset of the part of a file that a task reads, ``blk`` a block of
a bounded number of lines within it, ``ord`` orders the lines of a block.  (split, blk, ord) is the order of the lines of a file.

Whether a line ends inside a quoted field depends on whether it began inside one.  Each line is
therefore a function on these two states, found by patterns, with the number of records that begin in it from either state.  Such functions compose: those
of the lines of a block make the block's, those of blocks the split's, those of splits a run's (``RUN`` bytes of a file), and the few runs of a file are
folded.  On the way back each split, block and line learns its state and the number of records before it.  So no task sees more than a
block's lines, a split's blocks or a run's splits, however large the file is.

Files in which no line can open a field pass through untouched, which their content decides, and need no shuffle.

Quotes count only where a field begins.  Inside a quoted field ``""`` and backslash-quote are a quote; a backslash takes the next
character as it is.  A field that is never closed does not swallow its file: see ``stitch``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .partitioning import materialize

# The candidate delimiters in tie-break order.
DELIMITERS = [",", ";", "\t", "|"]
#: Inside of a quoted field, and a whole one; unrolled, so that Java's engine does not recurse for each character.
INSIDE = r'[^"\\]*(?:(?:""|\\.)[^"\\]*)*'
QUOTED = f'"{INSIDE}"(?!")'
#: A record of more lines or characters is none: its quote was never closed.
MAX_LINES, MAX_CHARS = 10_000, 16_000_000
#: Bytes of a file whose splits are composed together, as a power of two.
RUN = 37


def by_delimiter(delim: Column, build) -> Column:
    """``build(pattern of the delimiter, delimiter)`` for the row's delimiter."""
    made = [(d, build("\\" + d if d == "|" else d, d)) for d in DELIMITERS]
    return reduce(lambda acc, x: acc.when(delim == x[0], x[1]), made[1:], F.when(delim == made[0][0], made[0][1]))


def masked(line: Column, delim: Column) -> Column:
    """The line with each whole quoted field as ``Q``."""
    return by_delimiter(delim, lambda p, _: F.regexp_replace(line, f"(?s)(^|{p}){QUOTED}", "$1Q"))


def _opens(line: Column, delim: Column) -> Column:
    """Whether a line that begins outside a quoted field ends inside one."""
    m = masked(line, delim)
    return line.contains('"') & by_delimiter(delim, lambda p, _: m.rlike(f'(?:^|{p})"'))


def may_open(line: Column) -> Column:
    """Whether a line opens a field that it does not close, by any of the delimiters."""
    return reduce(lambda a, b: a | b, [_opens(line, F.lit(d)) for d in DELIMITERS])


def _stays_open(line: Column, delim: Column) -> Column:
    """Whether a line that begins inside a quoted field ends inside one."""
    end = f'^{INSIDE}"(?!")'
    return ~line.rlike(end) | _opens(F.regexp_replace(line, end, "Q"), delim)


def _chosen(state: Column, outside, inside) -> Column:
    return F.when(state == 0, outside).otherwise(inside)


def _composed(d: DataFrame, by: list[str], order: str) -> DataFrame:
    """The elements with what their group does before and up to each of them.

    An element has _s0, _s1 (the state after it, from state 0 outside and 1 inside) and _n0, _n1 (records that begin in it).  Added: _p0, _p1 (the state before
    it, if its group begins outside or inside), _m0, _m1 (records that begin in the group before it) and _last, whether it is the group's last.
    """
    w = Window.partitionBy(*by).orderBy(order)
    upto, before = w.rowsBetween(Window.unboundedPreceding, Window.currentRow), w.rowsBetween(Window.unboundedPreceding, -1)
    # a function is constant, the identity or a flip: the state is the last constant's, changed by the flips since
    d = d.withColumn("_flips", F.sum(((F.col("_s0") == 1) & (F.col("_s1") == 0)).cast("int")).over(upto))
    constant = F.when(F.col("_s0") == F.col("_s1"), F.struct(F.col("_s0").alias("to"), F.col("_flips").alias("flips")))
    d = d.withColumn("_const", F.last(constant, ignorenulls=True).over(upto)).withColumn("_last", F.lead(order).over(w).isNull())
    since = F.col("_flips") - F.coalesce(F.col("_const.flips"), F.lit(0))
    for b in (0, 1):
        d = d.withColumn(f"_a{b}", F.pmod(F.coalesce(F.col("_const.to"), F.lit(b)) + since, F.lit(2)).cast("int"))
        d = d.withColumn(f"_p{b}", F.coalesce(F.lag(f"_a{b}").over(w), F.lit(b)))
        d = d.withColumn(f"_m{b}", F.coalesce(F.sum(_chosen(F.col(f"_p{b}"), F.col("_n0"), F.col("_n1"))).over(before), F.lit(0)))
    return d.drop("_flips", "_const")


def _total(d: DataFrame, *keys) -> DataFrame:
    """The groups of ``_composed`` as elements: one row each."""
    after = [F.col(f"_a{b}").alias(f"_s{b}") for b in (0, 1)]
    count = [(F.col(f"_m{b}") + _chosen(F.col(f"_p{b}"), F.col("_n0"), F.col("_n1"))).alias(f"_n{b}") for b in (0, 1)]
    return d.where("_last").select(*keys, *after, *count)


def _begun(d: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """The elements of ``_composed`` with _state and _no before them, from those before their groups (by, _state, _no)."""
    d = d.join(groups.select(*by, F.col("_state").alias("_gs"), F.col("_no").alias("_gn")), by)
    d = d.withColumn("_state", _chosen(F.col("_gs"), F.col("_p0"), F.col("_p1")))
    return d.withColumn("_no", F.col("_gn") + _chosen(F.col("_gs"), F.col("_m0"), F.col("_m1"))).drop("_gs", "_gn")


def _run_begins(runs: DataFrame) -> DataFrame:
    """(file, run, _state, _no) before each run of a file, from (file, run, _s0, ...): a fold over the few runs."""
    listed = runs.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("run", "_s0", "_s1", "_n0", "_n1"))).alias("r"))
    start = F.struct(F.lit(0).alias("state"), F.lit(0).cast("long").alias("no"), F.array().cast("array<struct<run:bigint,_state:int,_no:bigint>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        here = F.struct(x["run"].alias("run"), acc["state"].alias("_state"), acc["no"].alias("_no"))
        return F.struct(_chosen(acc["state"], x["_s0"], x["_s1"]).alias("state"), (acc["no"] + _chosen(acc["state"], x["_n0"], x["_n1"])).alias("no"),
                        F.concat(acc["out"], F.array(here)).alias("out"))

    return listed.select("file", F.explode(F.aggregate("r", start, step, lambda a: a["out"])).alias("b")).select("file", "b.*")


def numbered(lines: DataFrame) -> DataFrame:
    """The lines (file, split, blk, ord, line, delimiter, ...) with _state and _after (0 outside, 1 inside a quoted field) and record_no (from 1).

    Written once: the functions of lines are found in one pass over their text.
    """
    d = lines.withColumn("_s0", _opens(F.col("line"), F.col("delimiter")).cast("int")).withColumn("_s1", _stays_open(F.col("line"), F.col("delimiter")).cast("int"))
    d = d.withColumn("_n0", F.lit(1).cast("long")).withColumn("_n1", F.lit(0).cast("long"))
    d = materialize(_composed(d, ["file", "split", "blk"], "ord"))
    blocks = _composed(_total(d, "file", "split", "blk"), ["file", "split"], "blk")
    splits = _composed(_total(blocks, "file", "split", F.shiftright("split", RUN).alias("run")), ["file", "run"], "split")
    splits = _begun(splits, _run_begins(_total(splits, "file", "run")), ["file", "run"])
    d = _begun(d, _begun(blocks, splits, ["file", "split"]), ["file", "split", "blk"])
    after = _chosen(F.col("_state"), F.col("_s0"), F.col("_s1"))
    return d.select(*lines.columns, "_state", after.alias("_after"), (F.col("_no") + (F.col("_state") == 0).cast("int")).alias("record_no"))


def stitch(lines: DataFrame, spanning: Column | None = None, max_lines: int = MAX_LINES, max_chars: int = MAX_CHARS) -> DataFrame:
    """One row a record from a line table with ``delimiter`` and further columns that are constant within a file.

    split, blk and ord are those of the record's first line, its lines are joined by a line feed; ``closed`` (boolean) is added.  A record whose quote is not closed
    at the end of its file, or that would have more than ``max_lines`` lines or ``max_chars`` characters, is its first line alone, not closed, and the
    lines after it are a record each.  So every line is in one record, and no record gathers more than the bound.

    ``spanning``: whether a line's file may have records of several lines (default: found here, by a pass over all lines).
    """
    keep = lines.columns
    if spanning is None:
        some = lines.where(_opens(F.col("line"), F.col("delimiter"))).select("file").distinct().withColumn("_spans", F.lit(True))
        lines, spanning = lines.join(some, "file", "left"), F.coalesce(F.col("_spans"), F.lit(False))
    whole = lines.where(~spanning).select(*keep, F.lit(True).alias("closed"))
    s = numbered(lines.where(spanning).select(*keep))
    single = s.where("_state = 0 and _after = 0").select(*keep, F.lit(True).alias("closed"))
    many = s.where("_state = 1 or _after = 1")
    sizes = many.groupBy("file", "record_no").agg(F.count("*").alias("n"), F.sum(F.length("line") + 1).alias("chars"), F.min("_after").alias("open"))
    many = many.join(sizes.withColumn("_whole", F.expr(f"open = 0 and n <= {max_lines} and chars <= {max_chars}")).select("file", "record_no", "_whole"), ["file", "record_no"])
    apart = many.where("not _whole").select(*keep, (F.col("_state") == 1).alias("closed"))
    rest = [c for c in keep if c not in ("file", "split", "blk", "ord", "line")]
    joined = many.where("_whole").groupBy("file", "record_no").agg(
        F.array_sort(F.collect_list(F.struct("split", "blk", "ord", "line"))).alias("l"), *[F.first(c).alias(c) for c in rest])
    first = F.get("l", F.lit(0))
    joined = joined.select("file", *[first[c].alias(c) for c in ("split", "blk", "ord")], F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("line"), *rest, F.lit(True).alias("closed"))
    return whole.unionByName(single).unionByName(apart).unionByName(joined.select(*keep, "closed"))
