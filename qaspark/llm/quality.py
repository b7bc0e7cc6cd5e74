"""Line-first cleaning (operator 7).

Each line is judged by punctuation, navigation and boilerplate rules; lines that fail are
removed, and a document that loses too much of its text that way is rejected.
Base figures (word and line repetition) reject too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Marks that end a sentence, and what may follow them.
TERMINAL, CLOSING = ".!?…:;。！？।؟", "\"'”’»)]*_ "
#: Marks between the entries of a menu or trail.
SEPARATORS = "|»›>•·→←"
#: A line is navigation when it has so many separators, and one for each so many words.
NAV_SEPARATORS, NAV_WORDS = 3, 4
#: Phrases of cookie bars, footers and sign-in boxes, in lower case.
BOILERPLATE = (
    "all rights reserved", "cookie policy", "we use cookies", "accept cookies", "privacy policy", "terms of use", "terms of service",
    "terms and conditions", "enable javascript", "javascript is disabled", "lorem ipsum", "sign up for our newsletter", "subscribe to our",
    "click here", "skip to content", "log in to", "sign in to", "share on facebook", "share on twitter", "powered by",
    "todos los derechos reservados", "política de privacidad", "tous droits réservés", "politique de confidentialité",
    "alle rechte vorbehalten", "datenschutzerklärung",
)
#: A boilerplate phrase fails a line of at most so many words; in longer lines it is prose about the subject.
BOILERPLATE_WORDS = 30
#: A document is rejected when its removed lines hold more than this share of its word characters.
MOST_LOST = 0.5

SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
          "n_lines long, n_removed_lines long, removed_chars long")
_SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def visible_chars(text: str) -> int:
    """Code points that are not ASCII white space."""
    return len(text) - sum(map(text.count, _SPACE))


def line_fails(line: str) -> str | None:
    """The rule by which a line with a word goes, or None: 'navigation', 'boilerplate' or 'punctuation'."""
    words = None
    seps = sum(map(line.count, SEPARATORS))
    if seps >= NAV_SEPARATORS:
        words = len(line.encode("utf-8", "replace").split())
        if seps * NAV_WORDS >= words:
            return "navigation"
    low = line.lower()
    if any(p in low for p in BOILERPLATE) and (words or len(line.encode("utf-8", "replace").split())) <= BOILERPLATE_WORDS:
        return "boilerplate"
    end = line.rstrip(_SPACE + CLOSING)
    return None if end and end[-1] in TERMINAL else "punctuation"


def repeat_words(words: list[bytes], k: int = 5) -> int:
    """How many words stand in a window of ``k`` words that the text has twice or more; 64-bit hashes stand for windows."""
    if len(words) <= k:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).astype(np.uint64)
    n = len(words) - k + 1
    w = np.zeros(n, np.uint64)
    for i in range(k):
        w = (w ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        w ^= w >> np.uint64(29)
    s = np.sort(w)
    if not (s[1:] == s[:-1]).any():
        return 0
    _, where, count = np.unique(w, return_inverse=True, return_counts=True)
    at = np.flatnonzero(count[where] > 1)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + k, -1)
    return int((np.cumsum(edge) > 0).sum())


def judge(text: str) -> tuple[list, list[str]]:
    """The figures of a text in the order of SCHEMA after doc_id, and the lines that stay."""
    words = text.encode("utf-8", "replace").split()  # bytes.split cuts at exactly the six ASCII white-space characters
    chars, seen, dup, lines, removed, lost, stay = visible_chars(text), set(), 0, 0, 0, 0, []
    for line in text.split("\n"):
        if not line.strip(_SPACE):
            stay.append(line)
            continue
        lines += 1
        dup += line in seen
        seen.add(line)
        if line_fails(line):
            removed += 1
            lost += visible_chars(line)
        else:
            stay.append(line)
    repeated = repeat_words(words)
    failed = len(words) < 10 or 100 * repeated > 20 * len(words)
    return [len(words), chars, sum(map(text.count, "#*$%&|<>")), dup, repeated, failed, not failed and lost <= MOST_LOST * chars, lines, removed, lost], stay


def clean_lines(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """Judge every row of documents (doc_id, text): the columns of SCHEMA, and clean_text when asked for.

    clean_text is the text without the lines that failed, also for a rejected document (``kept`` false).
    A null or empty text has no words: it fails the base figures, and its clean_text is empty.  Rows are judged one by one, so that
    repeated rows and ids give a row each, an empty table none; doc_id may be null; other columns are not read.
    """
    schema = SCHEMA + (", clean_text string" if with_text else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()] * 3
        for b in batches:
            figures, clean = [], []
            for t in b.column(1).to_pylist():
                row, stay = judge(t or "")
                figures.append(row)
                clean.append("\n".join(stay) if with_text else None)
            columns = [pa.array(c, k) for c, k in zip(zip(*figures) if figures else [[]] * 10, kinds)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns, *([pa.array(clean, pa.string())] if with_text else [])], [c.split()[0] for c in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def _sql_list(values: tuple[str, ...] | str) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


ORACLE = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (
  SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM d),
lw AS (
  SELECT *, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w,
         len(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) AS chars,
         len(line) - len(translate(line, '{SEPARATORS}', '')) AS seps,
         rtrim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || '{CLOSING.replace("'", "''")}') AS core,
         row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS nth FROM l),
lf AS (
  SELECT doc_id, nth, chars,
         (seps >= {NAV_SEPARATORS} AND seps * {NAV_WORDS} >= len(w))
         OR (len(list_filter({_sql_list(BOILERPLATE)}, lambda p: contains(lower(line), p))) > 0 AND len(w) <= {BOILERPLATE_WORDS})
         OR core = '' OR NOT contains('{TERMINAL}', right(core, 1)) AS fails
  FROM lw WHERE len(w) > 0),
lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (nth > 1) AS n_dup_lines, count(*) FILTER (fails) AS n_removed_lines,
         coalesce(sum(chars) FILTER (fails), 0)::BIGINT AS removed_chars FROM lf GROUP BY doc_id),
u AS (SELECT doc_id, unnest(w) AS v, generate_subscripts(w, 1) AS i FROM d),
win AS (
  SELECT doc_id, i, concat_ws(' ', v, lead(v) OVER o, lead(v, 2) OVER o, lead(v, 3) OVER o, lead(v, 4) OVER o) AS k, lead(v, 4) OVER o AS fifth
  FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
wk AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win WHERE fifth IS NOT NULL),
rep AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM wk WHERE c > 1) GROUP BY doc_id),
j AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, len(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (len(t) - len(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
         coalesce(n_lines, 0) AS n_lines, coalesce(n_removed_lines, 0) AS n_removed_lines, coalesce(removed_chars, 0) AS removed_chars
  FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND removed_chars <= {MOST_LOST} * word_chars AS kept,
       n_lines, n_removed_lines, removed_chars
FROM (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM j)
"""
