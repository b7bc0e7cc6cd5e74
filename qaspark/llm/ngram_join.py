"""Similarity join on n-gram sets by prefix trees (operator 8).

A document is the set of its k-word shingles (64-bit hashes).  Documents with equal sets are one class.  Classes
that may link meet in bounded groups, and each group is joined in a trie: its sets, ordered by one global order, are stored as
paths, so that a probe counts the overlap with all sets that share a path once, and leaves a subtree as soon as what remains of
the probe or of the subtree's sets cannot reach the threshold.

Which classes meet is exact too.  Sets of sizes a and b link only if they differ in at most (a + b) * (100 - p) / (100 + p) elements, so
of one part more than that, by ranges of the hash, one part at least is equal.  A class therefore writes one signature for
each part, at the level of its own size and the next, and linked classes share a signature.  There are somewhat more parts than that, so that
empty ones, which unrelated sets have alike, need none.  A part holds several shingles (about nine at 90 %, four at 80 %): a frequent word or shared passage alone does not bring documents together, as it would with single shingles as keys.
Each class first meets the least class of its signatures.  Groups of signatures that then still hold several components are compared by
sizes and by parities (a few bytes that bound the difference from below), and only pairs that these leave possible meet in tries again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qaspark.llm.common import broadcast_if_small, components, forget_chunks, in_groups
from qaspark.session import Scratch, written

#: Sets in a trie; larger groups are divided into blocks, and unresolved blocks meet in pairs.
GROUP = 128
#: Classes whose sizes and parities are compared in one place; larger groups are divided, and each two blocks meet.
COMPARED = 2048
#: Elements that a part of a set holds at least, on average, where parts are more than must be for the sake of empty ones.
PART = 2
#: Documents whose sets a task holds at a time.
SLICE = 500
#: Possible pairs that a task hands on at a time.
PAIRS = 200_000
_TABLE = np.random.default_rng(11).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = np.random.default_rng(12).integers(1, 1 << 63, 8, np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)])
SETS = "doc_id long, n long, d1 long, d2 long, signatures array<long>, parity binary"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(32)


def shingle_sets(texts: list[str], k: int = 3) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text: words between ASCII white space, A-Z lower-cased.

    A text of fewer than ``k`` words has its whole word sequence as one shingle; without words the set is empty.
    """
    out: list[np.ndarray] = []
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    for a, b in in_groups([len(r) for r in raw], 500_000):
        buffer = np.frombuffer(b" ".join([*raw[a:b], b""]), np.uint8)
        bounds = np.cumsum([0, *(len(r) + 1 for r in raw[a:b])])
        space = _SPACE[buffer]
        begins = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
        if not len(begins):
            out += [np.zeros(0, np.uint64)] * (b - a)
            continue
        at = np.flatnonzero(~space)
        first = np.searchsorted(at, begins)
        place = np.arange(len(at)) - np.repeat(first, np.diff([*first, len(at)]))
        power = np.cumprod(np.full(place.max() + 1, _ODD[0], np.uint64))
        words = _mix(np.add.reduceat(_TABLE[_LOWER[buffer[at]]] * power[place], first))
        of = np.searchsorted(begins, bounds)
        n = max(0, len(words) - k + 1)
        windows = np.zeros(n, np.uint64)
        for i in range(k):
            windows = windows + words[i : i + n] * _ODD[1 + i]
        windows = _mix(windows)
        for x, y in zip(of[:-1], of[1:]):
            if y - x >= k:
                out.append(np.unique(windows[x : y - k + 1]))
            elif y > x:
                out.append(_mix(np.array([np.add.reduce(words[x:y] * _ODD[1 : 1 + y - x]) + np.uint64(y - x)], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


class Levels:
    """Size classes so wide that linked sets are in the same or in neighbouring ones."""

    def __init__(self, percent: int):
        self.percent, self.begins, self.cut = percent, [1], []

    def of(self, n: int) -> int:
        while self.begins[-1] <= n:
            self.begins.append(100 * self.begins[-1] // self.percent + 1)
        return int(np.searchsorted(self.begins, n, "right")) - 1

    def parts(self, level: int) -> int:
        """One more than two linked sets of this level can differ in."""
        while len(self.begins) <= level + 1:
            self.begins.append(100 * self.begins[-1] // self.percent + 1)
        return 2 * (self.begins[level + 1] - 1) * (100 - self.percent) // (100 + self.percent) + 1

    def cuts(self, level: int) -> int:
        """Parts of a set at this level: of the smallest sets there, seldom one has fewer than ``parts`` that are not empty."""
        while len(self.cut) <= level:
            x, need = len(self.cut), self.parts(len(self.cut))
            n, m = self.begins[max(0, x - 1)], need
            while m < n / PART:
                one, two = (1 - 1 / m) ** n, (1 - 2 / m) ** n if m > 1 else 0.0
                spread = max(0.0, m * (m - 1) * two + m * one - (m * one) ** 2) ** 0.5
                if m * (1 - one) - 3 * spread >= need:
                    break
                m += max(1, m // 64)
            self.cut.append(m)
        return self.cut[level]

    def signatures(self, s: np.ndarray) -> np.ndarray:
        """Signatures of a sorted set, at its own level and the next.

        Of the parts, as many as are left when the differing ones are taken away are equal in linked sets.  So where more parts have elements than
        can differ, one of these is equal, and the empty parts, which sets that share nothing have alike, need no signature.
        """
        out, level = [], self.of(len(s))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(s + _ODD[6]))])
        for x in (level, level + 1):
            m = self.cuts(x)
            cut = np.searchsorted(s >> np.uint64(32), np.ceil(np.arange(m + 1) * (2.0**32 / m)).astype(np.uint64))
            own = np.flatnonzero(cut[1:] > cut[:-1])
            own = own if len(own) >= self.parts(x) else np.arange(m)
            out.append(_mix(total[cut[own + 1]] - total[cut[own]] + _mix(own.astype(np.uint64) + np.uint64(x << 32) + _ODD[7])))
        return np.concatenate(out)


def parity(s: np.ndarray, bits: int) -> np.ndarray:
    """Bits that tell for each remainder of the hashes by ``bits`` (a power of two, 64 or more) whether an odd number has it.

    Two sets' parities differ in no more bits than the sets differ in elements.
    """
    return np.packbits(np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1 > 0, bitorder="little").view(np.uint64)


def _folded(p: np.ndarray, words: int) -> np.ndarray:
    """The parity of fewer bits."""
    while len(p) > words:
        p = p[: len(p) // 2] ^ p[len(p) // 2 :]
    return p


def possible_pairs(sizes: np.ndarray, parities: list[np.ndarray], groups: list[int], percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """Of each set those of other groups that it may link with, by sizes and parities; each pair once, none that links is left out."""
    same = np.array(groups)
    words = np.array([len(p) for p in parities])
    for w in sorted(set(words.tolist())):
        # a set of few words against those of as many or more, folded to as many
        at = np.flatnonzero(words >= w)
        folded = np.stack([_folded(parities[i], w) for i in at])
        for x in np.flatnonzero(words == w):
            least, most = np.minimum(sizes[x], sizes[at]), np.maximum(sizes[x], sizes[at])
            differ = np.bitwise_count(folded ^ parities[x]).sum(1, dtype=np.int64)
            ok = (100 * least >= percent * most) & ((100 + percent) * differ <= (100 - percent) * (least + most)) & (same[at] != same[x])
            ok &= (words[at] > w) | (at > x)
            yield int(x), at[ok]


class _Node:
    """A run of elements; where it ends, sets may end or branch."""

    __slots__ = ("run", "next", "ends", "least", "most", "one")

    def __init__(self, run: np.ndarray):
        self.run, self.next, self.ends, self.least, self.most, self.one = run, {}, [], 1 << 62, 0, None


def trie_join(sets: list[np.ndarray], groups: list[int], percent: int) -> list[tuple[int, int]]:
    """Links between sets that join the given groups (set i is in groups[i]) to their linked components.

    Of the links inside a component only some are returned; none is returned or sought between sets
    known to be connected already.  Every two sets that link are connected at the end.
    """
    parent = list(range(len(sets)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    lead: dict[int, int] = {}
    for i, g in enumerate(groups):
        parent[find(i)] = find(lead.setdefault(g, i))
    # one order for all sets of the trie: frequent elements first, so that paths are shared
    elements, ranks, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.empty(len(elements), np.int64)
    order[np.lexsort((elements, -count))] = np.arange(len(elements))
    ranks, ends = order[ranks], np.cumsum([len(s) for s in sets])
    paths = [np.sort(ranks[e - len(s) : e]) for s, e in zip(sets, ends)]
    root, links = _Node(np.zeros(0, np.int64)), []
    for i in sorted(range(len(sets)), key=lambda i: len(sets[i])):
        x, size = paths[i], len(paths[i])
        if not size:
            continue
        member = np.zeros(len(elements), bool)
        member[x] = True
        passed = np.cumsum(member)
        stack = [(child, 0, 0) for child in root.next.values()]
        while stack:
            node, depth, overlap = stack.pop()
            if node.one is not None and find(node.one) == find(i):
                continue  # all sets below are connected with this one
            overlap += int(member[node.run].sum())
            depth += len(node.run)
            bound = overlap + min(size - int(passed[node.run[-1]]), node.most - depth)
            if (100 + percent) * bound < percent * (size + node.least):
                continue
            for j in node.ends:
                if (100 + percent) * overlap >= percent * (size + len(paths[j])) and find(j) != find(i):
                    links.append((i, j))
                    parent[find(j)] = find(i)
            stack += [(child, depth, overlap) for child in node.next.values()]
        node, rest = root, x
        while True:
            node.least, node.most = min(node.least, size), max(node.most, size)
            if not len(rest):
                node.ends.append(i)
                break
            child = node.next.get(int(rest[0]))
            if child is None:
                child = node.next[int(rest[0])] = _Node(rest)
                child.one = i
            else:
                if child.one is not None and find(child.one) != find(i):
                    child.one = None
                n = min(len(rest), len(child.run))
                differ = np.flatnonzero(rest[:n] != child.run[:n])
                shared = int(differ[0]) if len(differ) else n
                if shared < len(child.run):  # split the run
                    lower = _Node(child.run[shared:])
                    lower.next, lower.ends, lower.least, lower.most, lower.one = child.next, child.ends, child.least, child.most, child.one
                    if lower.one is None and all(find(e) == find(i) for e in lower.ends) and not lower.next and lower.ends:
                        lower.one = lower.ends[0]
                    child.run, child.next, child.ends = child.run[:shared], {int(lower.run[0]): lower}, []
            rest = rest[len(child.run):]
            node = child
    return links


def _sets(docs: DataFrame, percent: int, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_chunks()
        levels = Levels(percent)
        for b in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
            sets = shingle_sets([t or "" for t in b.column(1).to_pylist()], k)
            d = np.array([[np.add.reduce(_mix(s + _ODD[4])), np.add.reduce(_mix(s + _ODD[5]))] for s in sets], np.uint64).reshape(-1, 2)
            signatures = pa.array([levels.signatures(s).view(np.int64) if len(s) else [] for s in sets], pa.list_(pa.int64()))
            bits = [max(64, 1 << (4 * levels.parts(levels.of(len(s)))).bit_length()) if len(s) else 64 for s in sets]
            parities = pa.array([parity(s, n).tobytes() for s, n in zip(sets, bits)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(d[:, 0].copy().view(np.int64)), pa.array(d[:, 1].copy().view(np.int64)), signatures, parities],
                                             ["doc_id", "n", "d1", "d2", "signatures", "parity"])

    return docs.mapInArrow(run, SETS)


def _by_group(batches: Iterator[pa.RecordBatch], row) -> Iterator[tuple[list, list, list]]:
    """(ids, components, values) of each group, from batches (g, block, id, component, ...) that are sorted by g and block.

    ``row``: the values of a batch.
    """
    key, ids, components_, values = None, [], [], []
    for b in batches:
        for g, block, i, c, v in zip(*(b.column(x).to_pylist() for x in range(4)), row(b)):
            if key != (g, block):
                if ids:
                    yield ids, components_, values
                key, ids, components_, values = (g, block), [], [], []
            ids.append(i)
            components_.append(c)
            values.append(v)
    if ids:
        yield ids, components_, values


def _links(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["a", "b"])


def _arrays(pairs: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[i] for p in pairs])) for i in (0, 1)], ["a", "b"])


def _grouped(rows: DataFrame, run) -> DataFrame:
    return rows.repartition("g", "block").sortWithinPartitions("g", "block", "id").mapInArrow(run, "a long, b long").where("a != b").distinct()


def _verify(pairs: DataFrame, docs: DataFrame, percent: int, k: int, tables: Scratch) -> DataFrame:
    """Links (a, b) among the documents of pairs (g, id): each id meets g, and the others of its block, in a trie."""
    blocks = pairs.groupBy("g").agg(F.ceil(F.count("*") / F.lit(GROUP)).alias("blocks"))
    groups = (pairs.join(blocks, "g").select("g", F.pmod(F.xxhash64("id"), "blocks").alias("block"), "id")
              .unionAll(blocks.select("g", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.col("g").alias("id"))))
    groups = tables.written(groups.select("g", "block", "id", F.col("id").alias("component")), "join-groups")
    ids = tables.written(groups.select(F.col("id").alias("doc_id")).distinct(), "join-ids")
    texts = docs.join(broadcast_if_small(ids), "doc_id", "left_semi")
    rows = groups.join(texts, groups.id == texts.doc_id).select("g", "block", "id", "component", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids_, components_, sets in _by_group(batches, lambda b: shingle_sets([t or "" for t in b.column(4).to_pylist()], k)):
            if len(sets) > 1:
                yield _links([(ids_[i], ids_[j]) for i, j in trie_join(sets, components_, percent)])

    return _grouped(rows, run)


def _possible(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) in groups (g, block, id, component) that sizes and parities do not rule out; no text is moved for the others."""
    sizes = sets.where("n > 0").select(F.col("doc_id").alias("id"), "n", "parity")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(b: pa.RecordBatch) -> list:
            return list(zip(b.column(4).to_pylist(), b.column(5).to_pylist()))

        for ids_, components_, values in _by_group(batches, row):
            ids, pairs, n = np.array(ids_, np.int64), [], 0
            for i, js in possible_pairs(np.array([v[0] for v in values]), [np.frombuffer(v[1], np.uint64) for v in values], components_, percent):
                if len(js):
                    pairs.append((np.full(len(js), ids[i]), ids[js]))
                    n += len(js)
                if n >= PAIRS:
                    yield _arrays(pairs)
                    pairs, n = [], 0
            if pairs:
                yield _arrays(pairs)

    return _grouped(groups.join(sizes, "id").select("g", "block", "id", "component", "n", "parity"), run)


def join(docs: DataFrame, percent: int = 90, k: int = 3) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of documents (doc_id, text).

    Two documents link when 100 * |intersection| >= percent * |union| of their sets; component_id is the smallest doc_id
    reachable by links.  Null and empty texts and those without a word have the empty set and link with nothing, like rows with a null
    doc_id (their component_id is doc_id).  Rows that repeat a doc_id are joined by their own texts; each gets a row, an empty table none.  Other
    columns are not read.  Copies of any number are one class, found by a partial aggregate; signature groups are
    counted and led by a minimum, never gathered; tries hold at most a few hundred sets, comparisons of sizes and parities twice COMPARED.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with Scratch(docs.sparkSession) as tables:
        sets = tables.written(_sets(docs, percent, k), "join-sets")
        classes = tables.written(sets.where("n > 0 and doc_id is not null").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep")), "join-classes")
        reps = sets.join(broadcast_if_small(classes), (sets.doc_id == classes.rep) & (sets.d1 == classes.d1) & (sets.d2 == classes.d2), "left_semi")
        postings = reps.select(F.col("doc_id").alias("id"), F.explode("signatures").alias("g")).repartition("g")  # one shuffle for the count and the join
        shared = postings.groupBy("g").agg(F.count("*").alias("size"), F.min("id").alias("lead"), F.max("id").alias("last")).where("lead < last").select("g", "lead")
        members = tables.written(postings.join(shared.hint("shuffle_hash"), "g").select("g", "lead", "id").distinct(), "join-members")

        # first every class meets the least class that it shares a signature with
        first = tables.written(members.where("id != lead").groupBy("id").agg(F.min("lead").alias("g")), "join-first")
        links = tables.written(_verify(first, docs, percent, k, tables), "join-links")
        found = components(links)

        # then all groups that still hold several components; groups with the same members are one
        labelled = members.join(found, "id", "left").select("g", "id", F.coalesce("component_id", "id").alias("component"))
        open_groups = (labelled.groupBy("g").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.count("*").alias("size"),
                                                F.expr("bit_xor(xxhash64(id))").alias("h1"), F.expr("bit_xor(xxhash64(id, 1))").alias("h2"))
                       .where("least < most").groupBy("h1", "h2", "size").agg(F.min("g").alias("g")))
        rest = labelled.join(open_groups.select("g", F.ceil(F.col("size") / F.lit(COMPARED)).alias("blocks")), "g")
        own = F.pmod(F.xxhash64("id"), "blocks")
        # a group of several blocks: each two blocks meet once, block x * blocks + y holds blocks x <= y
        pair = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda o: F.least(o, own) * F.col("blocks") + F.greatest(o, own))
        rest = rest.select("g", F.explode(pair).alias("block"), "id", "component")
        pairs = tables.written(_possible(tables.written(rest, "join-rest"), sets, percent), "join-possible")
        more = tables.written(_verify(pairs.select(F.least("a", "b").alias("g"), F.greatest("a", "b").alias("id")).distinct(), docs, percent, k, tables), "join-more")
        found = components(links.unionAll(more)) if not more.isEmpty() else found

        labels = classes.join(found, classes.rep == found.id, "left").select("d1", "d2", F.coalesce("component_id", "rep").alias("component_id"))
        linked = sets.where("n > 0 and doc_id is not null").join(labels, ["d1", "d2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
        alone = sets.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
        return written(linked.unionAll(alone), "join-result")
