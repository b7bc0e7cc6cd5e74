"""SQL surface: ``register(spark)`` exposes the scorers to ``spark.sql``.

Native functions are SQL UDFs (``CREATE TEMPORARY FUNCTION ... RETURN``):
the optimizer inlines them, so they stay JVM-side and inside whole-stage
codegen.  The bit-parallel scorers are the same Arrow-batched pandas UDFs the DataFrame API uses.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import text as tx
from .grounding import LEADING, SYLLABLES, TRAILING, VOWELS, decompositions

_NATIVE = {
    "qa_normalize": ("s STRING", "STRING",
                     r"trim(regexp_replace(lower(coalesce(s, '')), '[^\\p{L}\\p{N}_-]+', ' '))"),
    "qa_tokens": ("s STRING", "ARRAY<STRING>", "filter(split(qa_normalize(s), ' '), t -> t <> '')"),
    "qa_em": ("a STRING, b STRING", "INT", "CAST(qa_normalize(a) = qa_normalize(b) AS INT)"),
    "qa_lev_sim": ("a STRING, b STRING", "DOUBLE",
                   "coalesce(1.0 - try_divide(levenshtein(qa_normalize(a), qa_normalize(b)), "
                   "greatest(length(qa_normalize(a)), length(qa_normalize(b)))), 1.0)"),
    "qa_jaccard": ("a STRING, b STRING", "DOUBLE",
                   "size(array_intersect(array_distinct(qa_tokens(a)), array_distinct(qa_tokens(b)))) / "
                   "greatest(size(array_union(array_distinct(qa_tokens(a)), array_distinct(qa_tokens(b)))), 1)"),
    "qa_oneline": ("s STRING", "STRING",
                   r"regexp_replace(regexp_replace(coalesce(s, ''), '(?U)\\s+', ' '), '(?U)^\\s+|\\s+$', '')"),
    "qa_strip_reasoning": ("s STRING", "STRING",
                           r"CASE WHEN s IS NULL OR s = '' THEN s ELSE regexp_replace(regexp_replace(regexp_replace("
                           r"regexp_replace(s, '(?is)<think>.*?</think>\\s*', ''), "
                           r"'(?is)```(?:reasoning|thought|inner_monologue).*?```', ''), "
                           r"'(?im)^\\s*(razonamiento|reasoning)\\s*:\\s*.*$', ''), '(?U)^\\s+|\\s+$', '') END"),
    "qa_cosine": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE",
                  "CASE WHEN size(a) = size(b) THEN aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, v) -> s + v) / "
                  "((CASE WHEN sqrt(aggregate(a, 0D, (s, x) -> s + x * x)) = 0 THEN 1D "
                  "ELSE sqrt(aggregate(a, 0D, (s, x) -> s + x * x)) END) * "
                  "(CASE WHEN sqrt(aggregate(b, 0D, (s, x) -> s + x * x)) = 0 THEN 1D "
                  "ELSE sqrt(aggregate(b, 0D, (s, x) -> s + x * x)) END)) END"),
}


def _fold_accents() -> str:
    """The body of qa_fold_accents, by the tables of ``grounding.fold_accents``."""
    def lit(text: str) -> str:
        return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"

    single, to, several, listed = map(lit, decompositions())
    syllable = (f"concat(substr({lit(LEADING)}, int(floor((ascii(c) - 44032) / 588)) + 1, 1), substr({lit(VOWELS)}, int(floor((ascii(c) - 44032) % 588 / 28)) + 1, 1), "
                f"if((ascii(c) - 44032) % 28 > 0, substr({lit(TRAILING)}, (ascii(c) - 44032) % 28, 1), ''))")
    expand = f"if(c rlike '{SYLLABLES}', {syllable}, substring_index(substring_index({listed}, concat('\x01', c), -1), '\x01', 1))"
    return (f"transform(array(translate(coalesce(s, ''), {single}, {to})), t -> if(not (t rlike '{SYLLABLES}') and translate(t, {several}, '') = t, t, "
            f"aggregate(filter(array_distinct(split(t, '')), c -> c rlike '{SYLLABLES}' or c <> '' and translate(c, {several}, '') = ''), t, "
            f"(a, c) -> replace(a, c, {expand}))))[0]")


def register(spark: SparkSession) -> list[str]:
    """Create the temporary SQL functions; returns their names."""
    native = _NATIVE | {"qa_fold_accents": ("s STRING", "STRING", _fold_accents())}
    for name, (args, ret, body) in native.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {ret} RETURN {body}")
    spark.udf.register("qa_pair_measures", tx._pair_measures_udf)  # (normalised pred, array of normalised refs) -> shared tokens, LCS, edits
    return list(native) + ["qa_pair_measures"]
