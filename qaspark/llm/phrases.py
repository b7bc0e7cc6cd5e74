"""Phrase collocations by multikey quicksort of suffix pointers (operator 13).

A suffix is the run of words from a place of a piece on, to a maximum depth.  Phrases are prefixes of suffixes: sorted
word by word, equal suffixes of d words lie together and their number is the count of a phrase of d words.

Nothing is sorted before it is known to matter.  Words and then pairs of words are counted over the corpus; suffixes
end before the first pair that is infrequent, as no frequent phrase goes on there.  What is left of three words and more is routed by its language and
leading pair, so that each task holds all suffixes of its pairs, and sorts them by multikey three-way
quicksort: a partition whose size is under the threshold is abandoned, the equal partition's size is the count of a phrase.
Leading pairs so frequent that a task should not hold them are routed by all their words, and the counts of
their phrases are sums over tasks.

Words are 64-bit hashes on the way.  The counts of words tell whether a frequent word shares its hash with any other
word of its language; then another seed is taken, so that the result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qaspark.llm.common import forget_chunks, in_groups
from qaspark.session import Scratch, written

#: Rows of a table of frequent words or pairs that tasks may hold to cut suffixes; beyond it they cut at fewer places, and more is counted.
KNOWN = 2_000_000
#: A leading pair of more suffixes is not routed to one task.
HOT = 20_000
#: Suffixes that are sorted at a time, besides the rest of a route.
SORTED = 200_000
#: Parts of a language in which the first ranks are sought before they meet.
RANK_PARTS = 64

#: Bytes: 0 in words, 1 between words, 2 between pieces.
_KIND = np.zeros(256, np.uint8)
_KIND[list(b" \t")] = 1
_KIND[list(b".,;:!?\n\v\f\r")] = 2
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
_ODD = np.random.default_rng(31).integers(1, 1 << 63, 8, np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(29)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Words of texts (binary, no nulls): (distinct words, index of each word, its piece, its text)."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    starts = (offsets - offsets[0])[:-1].astype(np.int64)
    kind = _KIND[raw]
    inside = kind == 0
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    first = starts[starts < len(raw)]
    begin[first] |= inside[first]  # a text's first word, whatever the text before ends with
    begins = np.flatnonzero(begin)
    letters = _LOWER[raw[inside]]
    places = (np.cumsum(inside)[begins] - 1).astype(np.int32)
    coded = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(np.append(places, np.int32(len(letters)))), pa.py_buffer(letters)]).dictionary_encode()
    text = np.searchsorted(starts, begins, "right") - 1
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64), np.cumsum(kind == 2)[begins] + text, text


def _hashed(values: list[bytes], seed: int) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(v, seed) for v in values), np.uint64, len(values))


class _Group:
    """The words of some documents with their languages' codes and hashes."""

    def __init__(self, langs: pa.Array, texts: pa.Array, seed: int):
        coded = langs.dictionary_encode()
        self.langs = coded.dictionary
        self.words, self.code, self.piece, text = words_of(texts)
        self.lang = coded.indices.to_numpy()[text].astype(np.int64)
        self.hash = _hashed(self.words.to_pylist(), seed)
        self.lang_hash = _hashed([x.encode() for x in self.langs.to_pylist()], seed)

    def pair_keys(self) -> np.ndarray:
        """Of each word and the next: a hash with the language."""
        return pair_key(self.lang_hash[self.lang[:-1]], self.hash[self.code[:-1]], self.hash[self.code[1:]])

    def together(self) -> np.ndarray:
        """Whether each word and the next are of one piece."""
        return self.piece[1:] == self.piece[:-1]


def pair_key(lang: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return _mix(lang * _ODD[0] + first * _ODD[1] + second * _ODD[2])


def _groups(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[_Group]:
    """Groups of documents of batches (lang, text)."""
    forget_chunks()
    for b in batches:
        texts = b.column(1).cast(pa.binary())
        for x, y in in_groups(pc.binary_length(texts).to_pylist()):
            yield _Group(b.column(0).slice(x, y - x), texts.slice(x, y - x), seed)


def _is_in(values: np.ndarray, known: np.ndarray | None) -> np.ndarray:
    """Whether values are in a sorted array; all are where nothing is known."""
    if known is None:
        return np.ones(len(values), bool)
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _count_words(docs: DataFrame, seed: int) -> DataFrame:
    """(lang, h, word, n): counts by task; of a null word, all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, seed):
            size = max(len(g.words), 1)
            key, n = np.unique(g.lang * size + g.code, return_counts=True)
            yield pa.RecordBatch.from_arrays([g.langs.take(pa.array(key // size)), _signed(g.hash[key % size]), g.words.take(pa.array(key % size)).cast(pa.string()), pa.array(n)],
                                             ["lang", "h", "word", "n"])
            lang, n = np.unique(g.lang, return_counts=True)
            yield pa.RecordBatch.from_arrays([g.langs.take(pa.array(lang)), pa.array(np.zeros(len(lang), np.int64)), pa.nulls(len(lang), pa.string()), pa.array(n)], ["lang", "h", "word", "n"])

    return docs.mapInArrow(run, "lang string, h long, word string, n long").groupBy("lang", "h", "word").agg(F.sum("n").alias("n"))


def _count_pairs(docs: DataFrame, seed: int, words: np.ndarray | None) -> DataFrame:
    """(lang, h1, h2, n) of pairs of frequent words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, seed):
            known = _is_in(g.hash, words)[g.code]
            at = np.flatnonzero(g.together() & known[1:] & known[:-1])
            size = max(len(g.words), 1)
            key, n = np.unique((g.lang[at] * size + g.code[at]) * size + g.code[at + 1], return_counts=True)
            yield pa.RecordBatch.from_arrays([g.langs.take(pa.array(key // size // size)), _signed(g.hash[key // size % size]), _signed(g.hash[key % size]), pa.array(n)], ["lang", "h1", "h2", "n"])

    return docs.mapInArrow(run, "lang string, h1 long, h2 long, n long").groupBy("lang", "h1", "h2").agg(F.sum("n").alias("n"))


def _suffixes(docs: DataFrame, seed: int, depth: int, pairs: np.ndarray | None, hot: np.ndarray | None) -> DataFrame:
    """(lang, route, hot, words, n): distinct suffixes of a group of documents, of 3 to ``depth`` words, cut before an infrequent pair; n: how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, seed):
            if len(g.code) < 3:
                continue
            keys = g.pair_keys()
            good = np.concatenate([g.together() & _is_in(keys, pairs), np.zeros(depth, bool)])
            at = np.flatnonzero(good[: len(keys)] & good[1 : len(keys) + 1])
            code = np.concatenate([g.code, np.zeros(depth, np.int64)])
            size, goes_on = len(g.words) + 1, np.ones(len(at), bool)
            columns, length, same = [], np.zeros(len(at), np.int64), g.lang[at]
            for j in range(depth):
                if j:
                    goes_on &= good[at + j - 1]
                columns.append(np.where(goes_on, code[at + j] + 1, 0))
                length += goes_on
                same = np.unique(same * size + columns[-1], return_inverse=True)[1]
            _, one, n = np.unique(same, return_index=True, return_counts=True)
            ids = np.stack(columns, 1)[one]
            hashes = np.where(ids > 0, g.hash[ids - 1], np.uint64(0))
            key, lang = keys[at[one]], g.lang[at[one]]
            is_hot = _is_in(key, hot)
            route = np.where(is_hot, _mix((hashes * _ODD[: depth]).sum(1, dtype=np.uint64) + key), key)
            words = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length[one])]).astype(np.int32)), _signed(hashes[ids > 0]))
            yield pa.RecordBatch.from_arrays([g.langs.take(pa.array(lang)), _signed(route), pa.array(is_hot), words, pa.array(n)], ["lang", "route", "hot", "words", "n"])

    return docs.mapInArrow(run, "lang string, route long, hot boolean, words array<long>, n long")


def quicksort(columns: np.ndarray, weights: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """Multikey three-way quicksort of suffixes (rows of ``columns``, 0 after their end): (row, depth, count) of each prefix whose count is ``least`` or more.

    Rows are pointers; a partition holds those that agree in ``depth`` words.  They are parted by the word of one in the middle at that depth: the equal ones agree in
    one more, and their weights add up to a prefix's count; the others are parted again.  Partitions of less weight are abandoned.
    """
    todo = [(np.arange(len(columns)), 0)]
    while todo:
        rows, depth = todo.pop()
        values = columns[rows, depth]
        pivot = np.partition(values, len(values) // 2)[len(values) // 2]
        for part, more in ((rows[values < pivot], 0), (rows[values > pivot], 0), (rows[values == pivot], 1)):
            size = int(weights[part].sum())
            if size < least or more and not pivot:
                continue
            if more:
                yield int(part[0]), depth + 1, size
            if depth + more < columns.shape[1]:
                todo.append((part, depth + more))


def _sort(suffixes: DataFrame, depth: int, least: int) -> DataFrame:
    """(lang, words, n) of phrases of three words or more in suffixes that are routed by their leading pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sort(table: pa.Table) -> pa.RecordBatch:
            langs = table.column("lang").combine_chunks().dictionary_encode()
            words = table.column("words").combine_chunks()
            length = pc.list_value_length(words).to_numpy()
            columns = np.zeros((len(length), depth + 1), np.uint64)
            columns[:, 0] = langs.indices.to_numpy() + 1  # the language is the first key
            columns[:, 1:][np.arange(depth) < length[:, None]] = words.flatten().to_numpy().view(np.uint64)
            found = [f for f in quicksort(columns, table.column("n").to_numpy(), least) if f[1] > 3]
            row, deep, n = (np.array(x, np.int64) for x in (zip(*found) if found else ([], [], [])))
            held = columns[row, 1:][np.arange(depth) < (deep - 1)[:, None]]
            phrases = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(deep - 1)]).astype(np.int32)), _signed(held))
            return pa.RecordBatch.from_arrays([langs.dictionary.take(langs.indices.take(pa.array(row))), phrases, pa.array(n)], ["lang", "words", "n"])

        waiting: list[pa.RecordBatch] = []
        for b in batches:
            waiting.append(b)
            if sum(map(len, waiting)) >= SORTED:
                table = pa.Table.from_batches(waiting)
                route = table.column("route").to_numpy()
                whole = int(np.searchsorted(route, route[-1]))  # the last route may go on
                if whole:
                    yield sort(table.slice(0, whole))
                waiting = table.slice(whole).to_batches()
        if waiting:
            yield sort(pa.Table.from_batches(waiting))

    rows = suffixes.repartition("route").sortWithinPartitions("route").select("route", "lang", "words", "n")
    return rows.mapInArrow(run, "lang string, words array<long>, n long")


def _known(table: DataFrame, *columns: str) -> list[np.ndarray] | None:
    """Columns of a table of numbers, if it has at most KNOWN rows: what tasks may hold to leave out what cannot be frequent."""
    if table.limit(KNOWN + 1).count() > KNOWN:
        return None
    got = table.select(*columns).toArrow()
    return [got.column(c).to_numpy() if got.num_rows else np.zeros(0, np.int64) for c in columns]


def _frequent(docs: DataFrame, depth: int, least: int, tables: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Written tables: phrases (lang, words, n) that come ``least`` times or more, their words (lang, h, word), and (lang, n) of all words."""
    for seed in range(8):
        counted = tables.written(_count_words(docs, seed), "phrase-words")
        words = counted.where((F.col("n") >= least) & F.col("word").isNotNull())
        others = counted.where("word is not null").select("lang", "h", F.col("word").alias("other"))
        if words.join(others, ["lang", "h"]).where("word != other").isEmpty():
            break
    else:
        raise RuntimeError("words share their hashes under every seed")
    langs = counted.where("word is null").select("lang", "n")
    known = _known(words, "h")
    pairs = tables.written(_count_pairs(docs, seed, known and np.unique(known[0].view(np.uint64))).where(F.col("n") >= least), "phrase-pairs")
    cut, hot = _pair_keys(pairs, seed)
    suffixes = tables.written(_suffixes(docs, seed, depth, cut, hot), "phrase-suffixes")
    sorted_ = _sort(suffixes.where("not hot"), depth, least)
    for d in range(3, depth + 1):
        of_hot = suffixes.where(F.col("hot") & (F.size("words") >= d)).groupBy("lang", F.slice("words", 1, d).alias("words"))
        sorted_ = sorted_.unionAll(of_hot.agg(F.sum("n").alias("n")).where(F.col("n") >= least))
    phrases = (words.select("lang", F.array("h").alias("words"), "n").unionAll(pairs.select("lang", F.array("h1", "h2").alias("words"), "n"))
               .unionAll(sorted_))
    return tables.written(phrases, "phrase-counts"), words.select("lang", "h", "word"), langs


def _pair_keys(pairs: DataFrame, seed: int) -> tuple[np.ndarray | None, np.ndarray | None]:
    """Sorted keys of the frequent pairs, and of the hot ones among them; (None, None) if they are too many: then nothing is cut, and all suffixes count as hot."""
    if (held := _known(pairs, "h1", "h2", "n")) is None:
        return None, None
    langs = pairs.select("lang").toArrow().column("lang").to_pylist()
    lang = _hashed([x.encode() for x in langs], seed)
    keys = pair_key(lang, held[0].view(np.uint64), held[1].view(np.uint64))
    return np.unique(keys), np.unique(keys[held[2] > HOT])


def frequent_phrases(docs: DataFrame, depth: int = 5, least: int = 100) -> DataFrame:
    """(lang, words array<string>, n): phrases of 1 to ``depth`` words that come ``least`` times or more in texts of a language.

    See ``collocations`` for the rows and texts.
    """
    with Scratch(docs.sparkSession) as tables:
        phrases, words, _ = _frequent(_rows(docs), depth, least, tables)
        return written(_with_words(phrases, words).select("lang", F.col("parts").alias("words"), "n"), "phrases")


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _with_words(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """phrases (lang, words, ...) with ``parts``, the words themselves."""
    names = (phrases.select("lang", "words", F.posexplode("words").alias("at", "h")).join(words, ["lang", "h"])
             .groupBy("lang", "words").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("parts")))
    return phrases.join(names.select("lang", "words", F.col("parts.word").alias("parts")), ["lang", "words"])


def collocations(docs: DataFrame, depth: int = 5, least: int = 100, top: int = 2000) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Texts of documents (lang, text) are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line ends, and these into words at spaces and tabs.  n counts
    all words of a language, a the places of a phrase of 2 to ``depth`` words within pieces, at least ``least``.  Of the cuts of a phrase into a first part
    (l places) and a rest (r) the one with the least floor(1000 * a * n / (l * r)) counts, the earliest of equal ones; that is its score.  A phrase that lies in a
    longer one that comes as often is dropped.  Ranks are by score and a, largest first, then by phrase in byte order.

    A null language is ``und``, a null text empty; repeated rows count again; texts of any length and words of any length are worked on whole.  A text without a word
    adds nothing, an empty table gives no row.  Other columns are not read.
    """
    with Scratch(docs.sparkSession) as tables:
        counts, words, langs = _frequent(_rows(docs), depth, least, tables)
        candidates = counts.where(F.size("words") > 1)
        # what lies in a longer phrase that is as frequent lies in one of one more word that is
        within = F.array(F.slice("words", F.lit(1), F.size("words") - 1), F.slice("words", F.lit(2), F.size("words") - 1))
        longer = candidates.where(F.size("words") > 2).select("lang", F.explode(within).alias("words"), "n").groupBy("lang", "words").agg(F.max("n").alias("longer"))
        kept = candidates.join(longer, ["lang", "words"], "left").where("longer is null or longer < n").select("lang", "words", F.col("n").alias("a"))
        cuts = kept.select("*", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
        cuts = cuts.select("*", F.slice("words", F.lit(1), F.col("k")).alias("first"), F.slice("words", F.col("k") + 1, F.size("words")).alias("rest"))
        cuts = (cuts.join(counts.select("lang", F.col("words").alias("first"), F.col("n").alias("l")), ["lang", "first"])
                .join(counts.select("lang", F.col("words").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
                .join(langs, "lang"))
        score = F.expr("(cast(1000 as decimal(4,0)) * cast(a as decimal(17,0)) * cast(n as decimal(16,0))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))")
        least_cut = cuts.groupBy("lang", "words").agg(F.min(F.struct(score.cast("long").alias("score"), "k", "a", "l", "r", "n")).alias("c"))
        scored = _with_words(least_cut.select("lang", "words", "c.*"), words).select("lang", F.array_join("parts", " ").alias("phrase"), "a", "l", "r", "n", "score")
        order = [F.desc("score"), F.desc("a"), "phrase"]
        part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
        first = scored.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
        ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
        return written(ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations")


ORACLE = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                                             '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
     runs AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM pieces),
     grams AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase
               FROM runs, (VALUES (1), (2), (3), (4), (5)) AS d(k) WHERE len(ws) >= k),
     f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING k = 1 OR count(*) >= 100),
     n AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
     c AS (SELECT lang, k, phrase, f, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND f >= 100),
     held AS (SELECT lang, array_to_string(ws[1:k - 1], ' ') AS phrase, f FROM c WHERE k > 2
              UNION ALL SELECT lang, array_to_string(ws[2:k], ' '), f FROM c WHERE k > 2),
     kept AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.lang = c.lang AND h.phrase = c.phrase AND h.f >= c.f)),
     cuts AS (SELECT lang, phrase, f AS a, ws, k, unnest(range(1, k)) AS j FROM kept),
     scored AS (SELECT c.lang, c.phrase, c.a, l.f AS l, r.f AS r, n.n::BIGINT AS n, c.j,
                       ((1000::HUGEINT * c.a * n.n) // (l.f::HUGEINT * r.f))::BIGINT AS score
                FROM cuts c JOIN n USING (lang)
                JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.ws[1:c.j], ' ')
                JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.ws[c.j + 1:c.k], ' ')),
     best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""
