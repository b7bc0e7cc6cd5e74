"""Helpers the operators of this package share."""

from __future__ import annotations

import dataclasses
import functools
import os
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qaspark.session import Scratch, written

#: Bytes of text that a Python task works on at a time.
GROUP_BYTES = 8_000_000
#: Distinct chunks a Python task remembers with their ids; beyond it, what was not met since the last time is forgotten.
CACHE_CHUNKS = 600_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def in_groups(lengths: list[int], most: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """(first, past-last) of runs of texts of at most ``most`` bytes together; a longer text is a run alone."""
    start, size = 0, 0
    for i, n in enumerate(lengths):
        if size and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(lengths):
        yield start, len(lengths)


@functools.lru_cache(maxsize=4)
def tokenizer(path: str):
    """A tokenizer of the tokenizers library, once for each Python worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    # their strings in a text are ordinary text, as the vocabularies' description has it: no text of a corpus can forge an end of document
    t.encode_special_tokens = True
    return t


def id_type(path: str) -> str:
    """The narrowest little-endian unsigned type that holds every id of the vocabulary."""
    return "<u2" if tokenizer(path).get_vocab_size() <= 1 << 16 else "<u4"


_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
#: What makes a text odd: a character besides printable ASCII, Latin letters (but U+0130, whose lower case is two characters) and the line feed;
#: a full stop or comma beside another mark.
_ODD = f"[^\n\x20-\x7eÀ-\u012f\u0131-ɏ]|[.,][^{_LETTERS}0-9 \n]|(?:^|[^{_LETTERS}0-9])[.,]"
#: A space before a plain visible character always begins a piece of a byte-level pre-tokenizer.
_BEFORE_PLAIN = re.compile("(?= [\x21-\x7eÀ-ɏ])")
#: Plain visible characters, after a space or not.
_WORD = re.compile(" ?[\x21-\x7eÀ-ɏ]+").fullmatch


@dataclasses.dataclass(frozen=True)
class Cut:
    """How texts are cut into chunks that a pre-tokenizer would cut them into, or into more than one of, in any case.

    Texts with a match of ``odd`` (an expression of Arrow's) are cut one by one by ``slow``; the others by Arrow, after ``mark`` has put \\0 at
    the cuts.  A chunk that is ``word`` as a whole is one piece to the pre-tokenizer, and no normalizer changes it.
    """

    odd: str
    slow: Callable[[str], list[str]]
    mark: Callable[[pa.Array], pa.Array]
    word: str

    def __call__(self, texts: list[str]) -> pa.ListArray:
        a = pa.array(texts, pa.string())
        for mark in ".,":
            a = pc.replace_substring(a, mark, f"\0{mark}\0")
        return pc.split_pattern(self.mark(a), "\0")


#: For byte-level pre-tokenizers: a space goes with what follows it.
BYTE_LEVEL = Cut(f"[ \n]\n|  |{_ODD}", _BEFORE_PLAIN.split,
                 lambda a: pc.replace_substring(pc.replace_substring(a, "\n", "\0\n\0"), " ", "\0 "), " ?[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: For pre-tokenizers that drop white space and case.
WORDS = Cut(_ODD, lambda t: t.replace("\n", " ").split(" "),
            lambda a: pc.replace_substring(pc.replace_substring(pc.ascii_lower(a), "\n", "\0"), " ", "\0"), "[a-zß-öø-ÿ]+")


class ChunkEncoder:
    """Ids of texts as bytes, chunk by chunk; what a chunk's ids are is remembered.

    ``encode_new`` maps a list of chunks to their ids, as bytes of ``dtype``.
    """

    def __init__(self, cut: Cut, encode_new: Callable[[list[str]], Iterable[bytes]], dtype: str):
        self.cut, self.encode_new, self.dtype = cut, encode_new, dtype
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _learn(self, chunks: list[str]) -> None:
        if len(self.known) > CACHE_CHUNKS:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        new = []
        for c in chunks:
            if c not in known:
                if (ids := older.get(c)) is None:
                    new.append(c)
                else:
                    known[c] = ids
        known.update(zip(new, self.encode_new(new), strict=True))

    def _encode(self, cut: pa.ListArray) -> list[bytes]:
        """Ids of each list of chunks."""
        coded = cut.flatten().dictionary_encode()
        chunks, at = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        self._learn(chunks)
        ids = [self.known[c] for c in chunks]
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // np.dtype(self.dtype).itemsize
        pool, first = np.frombuffer(b"".join(ids), self.dtype), np.cumsum(size) - size
        n = size[at]
        ends = np.concatenate([[0], np.cumsum(n)])
        out = pool[np.repeat(first[at] - ends[:-1], n) + np.arange(ends[-1])]
        bounds = ends[np.concatenate([[0], np.cumsum(cut.value_lengths().to_numpy())])]
        return [out[x:y].tobytes() for x, y in zip(bounds[:-1], bounds[1:])]

    def _group(self, texts: list[str]) -> list[bytes]:
        odd = pc.match_substring_regex(pa.array(texts, pa.string()), self.cut.odd).to_pylist()
        plain = iter(self._encode(self.cut([t for t, o in zip(texts, odd) if not o])) if not all(odd) else [])
        slow = iter(self._encode(pa.array([self.cut.slow(t) for t, o in zip(texts, odd) if o], pa.list_(pa.string()))) if any(odd) else [])
        return [next(slow if o else plain) for o in odd]

    def __call__(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text; a null is an empty text."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        return [x for a, b in in_groups(pc.binary_length(texts).to_pylist()) for x in self._group(texts.slice(a, b - a).to_pylist())]


def _letters(t, word: str) -> dict[int, str] | None:
    """What the tokenizer makes of each character of a ``word``; None if that is not character by character or not one piece."""
    def pieces(text: str) -> list[str]:
        text = t.normalizer.normalize_str(text) if t.normalizer else text
        return [p for p, _ in t.pre_tokenizer.pre_tokenize_str(text)] if t.pre_tokenizer else []

    alone = [c for c in map(chr, range(1, 256)) if re.fullmatch(word, c)]
    table = {ord(c): pieces(c) for c in alone}
    if not all(len(p) == 1 for p in table.values()):
        return None
    table = {c: p[0] for c, p in table.items()}
    if re.fullmatch(word, f" {alone[0]}"):
        table[ord(" ")] = "".join(pieces(f" {alone[0]}")).removesuffix(table[ord(alone[0])])
    whole = "".join(alone)
    whole = [whole, f" {whole}"] if ord(" ") in table else [whole]
    return table if all(pieces(w) == [w.translate(table)] for w in whole) else None


@functools.lru_cache(maxsize=2)
def library_encoder(path: str, cut: Cut, separator: str) -> ChunkEncoder:
    """A ``ChunkEncoder`` on the tokenizers library, once for each Python worker.

    Words of letters, most of the new chunks, go to the library's model at once, in the letters of its vocabulary: on them the
    normalizer and pre-tokenizer would cost several times the merges.  The others are encoded some thousands at a time, with
    ``separator`` between them, which must be one id that no chunk of plain
    visible characters has.  Chunks with white space or control characters inside are encoded alone.
    """
    t = tokenizer(path)
    (mark,) = t.encode(separator, add_special_tokens=False).ids
    dtype = id_type(path)

    width = np.dtype(dtype).itemsize

    def alone(chunks: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype).tobytes() for e in t.encode_batch_fast(chunks, add_special_tokens=False)]

    def run(chunks: list[str]) -> list[bytes]:
        (e,) = t.encode_batch_fast([separator.join(chunks)], add_special_tokens=False)
        ids = np.array(e.ids, dtype)
        at = (width * np.flatnonzero(ids == mark)).tolist()
        if len(at) != len(chunks) - 1:
            return alone(chunks)
        raw = ids.tobytes()
        return [raw[x:y] for x, y in zip([0, *[i + width for i in at]], [*at, len(raw)])]

    word, letters, merge = re.compile(cut.word).fullmatch, _letters(t, cut.word), t.model.tokenize

    def words(chunks: list[str]) -> Iterator[bytes]:
        ids, ends = [], [0]
        for c in "\n".join(chunks).translate(letters).split("\n") if chunks else ():
            ids += [x.id for x in merge(c)]
            ends.append(width * len(ids))
        raw = np.array(ids, dtype).tobytes()
        return (raw[x:y] for x, y in zip(ends, ends[1:]))

    def encode_new(chunks: list[str]) -> list[bytes]:
        plain = [c for c in chunks if word(c)] if letters else []
        out = dict(zip(plain, words(plain), strict=True))
        easy = [c for c in chunks if c not in out and _WORD(c)]
        out.update(zip(easy, (x for i in range(0, len(easy), 4000) for x in run(easy[i : i + 4000])), strict=True))
        hard = [c for c in chunks if c not in out]
        out.update(zip(hard, alone(hard), strict=True))
        return [out[c] for c in chunks]

    return ChunkEncoder(cut, encode_new, dtype)


def forget_chunks() -> None:
    """Free the chunks that an encoder has left in this Python worker, which Spark uses again for other operators."""
    library_encoder.cache_clear()


def broadcast_if_small(table: DataFrame, most_rows: int = 1_000_000) -> DataFrame:
    """A written table of a few numbers a row, to be broadcast if it is as small as that; else any join may be chosen."""
    return F.broadcast(table) if table.limit(most_rows + 1).count() <= most_rows else table


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph, by alternating large and small stars.

    ``edges``: columns a, b (long; a row with a null or with a = b links nothing).  Returns (id, component_id), a written table:
    each node of an edge with the smallest id it is connected to.  Neighbours are never gathered, only their minimum is,
    so a hub is a skewed join at worst, which AQE splits.  Raises if ``most_rounds``
    (each halves distances) don't suffice.
    """
    with Scratch(edges.sparkSession) as s:
        e = s.written(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
        before = None
        for _ in range(most_rounds):
            # large star: every larger neighbour of u moves to the smallest node around u
            both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
            large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
            large = s.written(large, "large-star")
            # small star: u and its smaller neighbours move to the smallest of them
            least = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            e = s.written(small.unionAll(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
            now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum(F.xxhash64("v", "u") % 999_983)).first())
            if now == before:
                roots = e.select(F.col("v").alias("id")).distinct()
                found = e.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
                return written(found.unionAll(roots.select("id", F.col("id").alias("component_id"))), "components")
            before = now
    raise RuntimeError("components did not settle")
