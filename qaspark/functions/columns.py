"""Column helpers: numeric coercion, names, provenance, slugs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What counts as a number in a text cell (pandas to_numeric
# accepts these; '1d', 'x' and '' become null), and the ordinal marks folded
# by the column-name normaliser.
NUMERIC_TEXT = r"^\s*[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|inf|infinity|nan)\s*$"
ORDINAL_FOLD = {"º": "o", "ª": "a"}


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def safe_double(x, dtype: str | None = None) -> Column:
    """Numeric coercion, bad text -> null, NaN -> null (pandas mean skips NaN)."""
    c = _c(x)
    if dtype is not None and dtype not in ("string",):
        v = c.cast("double")
    else:
        s = c.cast("string")
        v = F.when(F.lower(s).rlike(NUMERIC_TEXT), s.try_cast("double"))
    return F.when(F.isnan(v), F.lit(None).cast("double")).otherwise(v)


def norm_col(name: str | None) -> str:
    """The [a-z0-9] runs of the folded lower-case name, joined by '_'; null -> ''."""
    return "_".join(re.findall("[a-z0-9]+", (name or "").lower().translate(str.maketrans(ORDINAL_FOLD))))


def norm_col_expr(name) -> Column:
    """P1 as an expression."""
    folded = F.translate(F.lower(F.coalesce(_c(name), F.lit(""))), "".join(ORDINAL_FOLD), "".join(ORDINAL_FOLD.values()))
    return F.array_join(F.regexp_extract_all(folded, F.lit("[a-z0-9]+"), F.lit(0)), "_")


def unique_names(names: list[str]) -> list[str]:
    """Q9: a name that is taken already gets the first free _2, _3 ...; given names are never renamed for a made one."""
    given, out = set(names), []
    for n in names:
        k = 2
        new = n
        while new in out or (new != n and new in given):
            new, k = f"{n}_{k}", k + 1
        out.append(new)
    return out


def normalise_columns(df: DataFrame) -> DataFrame:
    """P1 over a DataFrame's names (schema only, no job); collisions get _2, _3 ..."""
    return df.toDF(*unique_names([norm_col(c) for c in df.columns]))


def lang_from_path(path) -> Column:
    """First path part starting bench_out_ -> its suffix, else the file
    name after its last '_' (extension kept), else 'unknown'."""
    p = _c(path)
    from_dir = F.regexp_extract(p, r"(?:^|/)bench_out_([^/]*)/", 1)
    name = F.element_at(F.split(p, "/"), -1)
    tail = F.when(F.instr(name, "_") > 0, F.substring_index(name, "_", -1))
    return F.coalesce(F.nullif(from_dir, F.lit("")), tail, F.lit("unknown"))


def slug(x) -> Column:
    """Runs of non-alphanumerics -> '_'."""
    return F.regexp_replace(_c(x), r"[^A-Za-z0-9]+", "_")


def ms_to_s(x) -> Column:
    """P7."""
    return _c(x) / 1000.0


# The preferred column order of the robust aggregation (known
# names first, the rest alphabetical).
PREFERRED_ORDER = [
    "run_id", "dataset", "split", "question_id", "question", "options", "answer",
    "gold", "gold_explanation", "prediction", "prediction_explanation",
    "is_correct", "score", "latency_ms", "duration_ms",
    "model", "temperature", "top_p", "seed",
    "prompt_tokens", "completion_tokens", "total_tokens",
    "n_tokens_prompt", "n_tokens_completion",
    "timestamp", "source_file",
]
# Labels of the per-record document template, the episode
# file-name pattern, the fallback source name and the snippet length.
RECORD_LABELS = ("Título", "Temporada", "Episodio", "Sinopsis", "Personajes destacados")
EPISODE_FILE = "s01e%02d.txt"
UNKNOWN_SOURCE = "desconocido"
SNIPPET_CHARS = 300


def preferred_order(df: DataFrame, preferred: list[str] = PREFERRED_ORDER) -> DataFrame:
    """Known names first in the preferred order, then the rest alphabetically."""
    first = [c for c in preferred if c in df.columns]
    return df.select(*first, *sorted(c for c in df.columns if c not in first))


def record_text(title, episode, synopsis, characters, season=1) -> Column:
    """One document per record from the label template."""
    lines = [(RECORD_LABELS[0], _c(title)), (RECORD_LABELS[1], F.lit(season).cast("string")),
             (RECORD_LABELS[2], _c(episode).cast("string")), (RECORD_LABELS[3], _c(synopsis)),
             (RECORD_LABELS[4], _c(characters))]
    return F.concat(*[x for label, v in lines for x in (F.lit(f"{label}: "), F.coalesce(v, F.lit("")), F.lit("\n"))])


def episode_file(episode) -> Column:
    """The record's file name."""
    return F.format_string(EPISODE_FILE, _c(episode).cast("int"))


def source_snippet(text, file_name) -> Column:
    """(file or the unknown marker, first 300 characters of the trimmed text)."""
    return F.struct(F.coalesce(_c(file_name), F.lit(UNKNOWN_SOURCE)).alias("file"),
                    F.substring(F.regexp_replace(_c(text), r"(?U)^\s+|\s+$", ""), 1, SNIPPET_CHARS).alias("text"))


def fmt_pct(x) -> Column:
    """0.1234 -> '12.3%' (null -> 'nan')."""
    return F.coalesce(F.format_string("%.1f%%", _c(x) * 100.0), F.lit("nan"))
