"""U5 over tables: benchmark passages found in a corpus (contamination).

Both sides are sets of distinct n-word shingles (normalised tokens, T1/T2), as pairs of independent 64-bit hashes.  A document that
holds a share t of an item's n shingles holds at least one of any n - ceil(t * n) + 1 of them.  So documents are sought by the
rarest ones only: the items' shingles are ordered by the number of documents that have them, and the first so many of each item are its prefix.
A shingle that every document has, such as boilerplate, is in a prefix only where an item consists of little else.

Documents meet items on prefix shingles alone.  A shingle with more documents than ``HEAVY`` is split: its documents are dealt to parts by their hash,
and its items are copied to each part.  The pairs found so are counted over whole sets; nothing else is formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .partitioning import materialize

SHINGLE_WORDS = 8
#: Documents of a shingle that meet its items in one place.
HEAVY = 5_000


def shingles_of_tokens(toks: str, n: int = SHINGLE_WORDS) -> Column:
    """Distinct n-word shingles of a token column; shorter texts give one shingle."""
    t = F.col(toks)
    win = F.transform(F.sequence(F.lit(0), F.size(t) - n), lambda i: F.array_join(F.slice(t, i + 1, n), " "))
    return F.array_distinct(F.when(F.size(t) >= n, win)
                            .when(F.size(t) > 0, F.array(F.array_join(t, " ")))
                            .otherwise(F.array().cast("array<string>")))


def _sets(df: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """(id, sh): the hashed distinct shingles of each row."""
    d = df.select(F.col(id_col), tx.tokens(text_col).alias("_toks"))
    d = d.select(id_col, shingles_of_tokens("_toks", n).alias("_sh"))
    return d.select(id_col, F.transform("_sh", lambda s: F.struct(F.xxhash64(s).alias("h1"), F.xxhash64(F.lit(1), s).alias("h2"))).alias("sh"))


def _exploded(sets: DataFrame, *cols: str) -> DataFrame:
    # explode_outer + a filter above the generator: a plain explode makes
    # Spark infer size(sh) > 0 and push it below the projections, which
    # re-evaluates the whole tokenisation inside the shingle lambda
    return sets.select(*cols, F.explode_outer("sh").alias("s")).where(F.col("s").isNotNull())


def prefixes(items: DataFrame, postings: DataFrame, item_id: str, min_containment: float) -> DataFrame:
    """(item, s, parts): the rarest shingles of each item of sets (item, sh), as many as any document above the containment must have one of.

    postings: (doc, s) of the documents.  parts: in how many a shingle's documents are dealt.  A shingle without a document counts, but leads to none.
    """
    often = postings.groupBy("s").agg(F.count("*").alias("df"))
    each = _exploded(items, item_id).join(often, "s", "left").select(item_id, F.coalesce("df", F.lit(0)).alias("df"), "s")
    ordered = each.groupBy(item_id).agg(F.array_sort(F.collect_list(F.struct("df", "s"))).alias("o"))
    most = F.size("o") - F.ceil(F.size("o") * F.lit(min_containment) - F.lit(1e-9)).cast("int") + 1
    first = ordered.select(item_id, F.explode(F.slice("o", F.lit(1), F.least(most, F.size("o")))).alias("p")).where("p.df > 0")
    return first.select(item_id, F.col("p.s").alias("s"), F.ceil(F.col("p.df") / HEAVY).cast("int").alias("parts"))


def contamination(corpus: DataFrame, items: DataFrame, corpus_id: str = "doc_id", item_id: str = "item_id",
                  text_col: str = "text", n: int = SHINGLE_WORDS, min_containment: float = 0.5) -> DataFrame:
    """(item_id, doc_id, shared, n_item_shingles, containment) with containment >= min_containment (over 0)."""
    it = materialize(_sets(items, item_id, text_col, n))
    wanted = _exploded(it).distinct()
    # of the corpus only shingles that some item has go on: filtered by the few distinct ones
    held = materialize(_exploded(_sets(corpus, corpus_id, text_col, n), corpus_id).join(wanted, "s", "left_semi"))
    prefix = prefixes(it, held, item_id, min_containment)
    parts = prefix.groupBy("s").agg(F.first("parts").alias("parts"))
    dealt = held.join(parts, "s").select("s", corpus_id, F.pmod(F.xxhash64(corpus_id), "parts").cast("int").alias("part"))
    copied = prefix.select("s", item_id, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    pairs = dealt.join(copied, ["s", "part"]).select(corpus_id, item_id).distinct()
    # whole sets of the pairs only
    own = held.groupBy(corpus_id).agg(F.collect_list("s").alias("d")).join(pairs, corpus_id)
    met = own.join(it, item_id).select(item_id, corpus_id, F.size(F.array_intersect("d", "sh")).cast("long").alias("shared"), F.size("sh").alias("n_item_shingles"))
    return (met.withColumn("containment", F.col("shared") / F.col("n_item_shingles"))
            .where(F.col("containment") >= min_containment)
            .select(item_id, corpus_id, "shared", "n_item_shingles", "containment"))
