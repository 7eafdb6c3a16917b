"""SimHash near-duplicates by a binary trie self-join.

Fingerprints within ``budget`` differing bits agree on at least ``agree`` of ``budget + agree`` equal blocks, so each
distinct fingerprint goes to one trie per choice of blocks, with those bits first: they are the path from the root to the
part of the trie that a task holds. One block will do for small budgets, larger ones take two, so that paths stay long.
Pairs of trie nodes descend together and add up differing bits; a pair over the budget is cut with all below it. A task
keeps a union-find over what it holds and emits a spanning star, never all pairs of a dense group. The stars meet in
alternating large-star and small-star rounds.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemolake.llm.common import cut, discard, document_key, texts

BUDGET = 3
#: Node pairs with at most this many fingerprint pairs below them are compared directly.
LEAF_PAIRS = 64
#: Node pairs held at once.
FRONTIER = 1 << 18


def _majority(hashes: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def _hashes(words: list[bytes], shingle: int, seed: int) -> np.ndarray:
    """XXH64 of the shingles of at least one word, in the order of the text."""
    joined = memoryview(b" ".join(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    k = max(1, min(shingle, len(words)))
    n = len(words) - k + 1
    hashing = xxhash.xxh64_intdigest
    return np.fromiter((hashing(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[k - 1 :].tolist())), np.uint64, n)


def fingerprints(text: bytes, shingle: int = 3, seed: int = 42, second: bool = False) -> tuple[int, int]:
    """SimHash of the word shingles; and on request one of other bits, from the shingles' hashes mixed again."""
    words = text.lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0, 0
    hashes = _hashes(words, shingle, seed)
    first = _majority(hashes)
    if not second:
        return first, 0
    hashes = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    hashes = (hashes ^ (hashes >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return first, _majority(hashes ^ (hashes >> np.uint64(31)))


def fingerprint(text: bytes, shingle: int = 3) -> int:
    return fingerprints(text, shingle)[0]


def _fingerprints(shingle: int, second: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprints(t, shingle, second=second) for t in texts(batch)], np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.record_batch([batch.column(0), pa.array(found[:, 0]), pa.array(found[:, 1])], names=["doc_id", "fp", "fp2"])

    return run


def simhash(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text", second: bool = False) -> DataFrame:
    """(doc_id, fp, fp2): 64-bit SimHash over word shingles as a signed long; zero for texts without words. fp2 has other
    bits of the same shingles, or is zero if not asked for."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(_fingerprints(shingle, second), "doc_id long, fp long, fp2 long")


class _Forest:
    """Smallest member of each group under batches of links, vectorised."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            self._flatten()
            la, lb = self.label[a], self.label[b]
            apart = la != lb
            if not apart.any():
                return
            a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
            np.minimum.at(self.label, np.maximum(la, lb), np.minimum(la, lb))

    def _flatten(self) -> None:
        while (up := self.label[self.label] != self.label).any():
            self.label[up] = self.label[self.label[up]]


def trie_links(keys: np.ndarray, prefix: int, budget: int = BUDGET, bits: int = 64, others: np.ndarray | None = None, confirm: int = 64, pairs: _Nearest | None = None) -> np.ndarray:
    """Group labels (indices) of sorted distinct ``keys`` after linking those within ``budget`` bits and one ``prefix``,
    and whose ``others``, where given, are within ``confirm`` bits. ``pairs`` takes the linked pairs themselves."""
    forest = _Forest(len(keys))
    top = keys >> np.uint64(bits - prefix) if prefix else np.zeros(len(keys), np.uint64)
    edges = np.concatenate([[0], np.flatnonzero(top[1:] != top[:-1]) + 1, [len(keys)]])
    lo, hi = edges[:-1], edges[1:]
    many = hi - lo > 1
    stack = [(prefix, np.stack([lo[many], hi[many], lo[many], hi[many], np.zeros(many.sum(), np.int64)]))]
    ones: dict[int, np.ndarray] = {}
    while stack:
        depth, nodes = stack.pop()
        if nodes.shape[1] > FRONTIER:
            stack += [(depth, nodes[:, FRONTIER:]), (depth, nodes[:, :FRONTIER])]
            continue
        a0, a1, b0, b1, d = nodes
        small = ((a1 - a0) * (b1 - b0) <= LEAF_PAIRS) | (depth == bits)
        if small.any():
            _compare(keys, nodes[:, small], budget, forest, others, confirm, pairs)
            nodes = nodes[:, ~small]
        if not nodes.shape[1]:
            continue
        if depth not in ones:
            ones[depth] = np.concatenate([[0], np.cumsum((keys >> np.uint64(bits - 1 - depth)) & np.uint64(1))]).astype(np.int64)
        count = ones[depth]
        a0, a1, b0, b1, d = nodes
        am, bm = a1 - (count[a1] - count[a0]), b1 - (count[b1] - count[b0])
        same = a0 == b0
        children = [
            np.stack([a0, am, b0, bm, d]), np.stack([am, a1, bm, b1, d]), np.stack([a0, am, bm, b1, d + 1]),
            np.stack([am, a1, b0, bm, d + 1])[:, ~same],
        ]
        nodes = np.concatenate(children, axis=1)
        a0, a1, b0, b1, d = nodes
        alive = (a1 > a0) & (b1 > b0) & (d <= budget) & ~((a0 == b0) & (a1 - a0 < 2))
        stack.append((depth + 1, nodes[:, alive]))
    forest._flatten()
    return forest.label


def _compare(keys: np.ndarray, nodes: np.ndarray, budget: int, forest: _Forest, others: np.ndarray | None, confirm: int, pairs: _Nearest | None) -> None:
    a0, a1, b0, b1, _ = nodes
    sizes = (a1 - a0) * (b1 - b0)
    for part in np.array_split(np.arange(len(sizes)), max(1, int(sizes.sum() >> 22))):
        size = sizes[part]
        pair = np.repeat(part, size)
        nth = np.arange(len(pair)) - np.repeat(np.cumsum(size) - size, size)
        width = (b1 - b0)[pair]
        i, j = a0[pair] + nth // width, b0[pair] + nth % width
        near = np.bitwise_count(keys[i] ^ keys[j]) <= budget
        near &= i < j
        if others is not None:
            near[near] = np.bitwise_count(others[i[near]] ^ others[j[near]]) <= confirm
        if near.any() and pairs is not None:
            pairs.add(i[near], j[near], np.bitwise_count(keys[i[near]] ^ keys[j[near]]).astype(np.int64))
        elif near.any():
            forest.link(i[near], j[near])


def _choices(budget: int) -> tuple[int, list[np.ndarray]]:
    """Bits of the path, and for every choice of blocks the bits' order, highest first."""
    agree = 1 if budget <= 3 else 2
    width = 64 // (budget + agree)
    blocks = [list(range(63 - width * i, 63 - width * (i + 1), -1)) for i in range(budget + agree)]
    orders = []
    for chosen in itertools.combinations(blocks, agree):
        first = [bit for block in chosen for bit in block]
        orders.append(np.array(first + [bit for bit in range(63, -1, -1) if bit not in first]))
    return agree * width, orders


def _permuted(keys: np.ndarray, order: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(keys.byteswap().view(np.uint8).reshape(-1, 8), axis=1)  # highest bit first
    return np.ascontiguousarray(np.packbits(bits[:, 63 - order], axis=1)).view(np.uint64).ravel().byteswap()


def _spread(budget: int):
    path, orders = _choices(budget)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for choice, order in enumerate(orders):
                start = _permuted(fp, order) >> np.uint64(64 - path)
                yield pa.record_batch([pa.array((start + np.uint64(choice << path)).astype(np.int64)), batch.column(0)], names=["path", "fp"])

    return run


def _grouped(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[list[np.ndarray]]:
    """The columns of each run of rows with one value in the first column; rows come sorted by it."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        parts = [batch.column(c).to_numpy() for c in range(columns)]
        edges = [0, *(np.flatnonzero(parts[0][1:] != parts[0][:-1]) + 1).tolist(), len(parts[0])]
        for low, high in zip(edges, edges[1:]):
            if held and held[0][0][0] != parts[0][low]:
                yield [np.concatenate([h[c] for h in held]) for c in range(columns)]
                held = []
            held.append([p[low:high] for p in parts])
    if held:
        yield [np.concatenate([h[c] for h in held]) for c in range(columns)]


def _links(budget: int):
    bits, orders = _choices(budget)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, fp in _grouped(batches, 2):  # a path of the trie at a time
            if len(fp) < 2:
                continue
            keys = _permuted(fp.view(np.uint64), orders[int(path[0]) >> bits])
            order = np.argsort(keys)
            label = trie_links(keys[order], bits, budget)
            linked = np.flatnonzero(label != np.arange(len(label)))
            if len(linked):
                yield pa.record_batch([pa.array(fp[order[linked]]), pa.array(fp[order[label[linked]]])], names=["a", "b"])

    return run


def links(fingerprints: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(a, b): links that connect all of the distinct ``fp`` within ``budget`` bits; spanning stars, not all pairs."""
    spread = fingerprints.select("fp").mapInArrow(_spread(budget), "path long, fp long")
    return spread.repartition("path").sortWithinPartitions("path").mapInArrow(_links(budget), "a long, b long")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) with the smallest node of each connected component, for nodes with an edge.

    Large-star hangs every larger neighbour of a node on its smallest one, small-star does so for smaller neighbours;
    alternated, they end in stars after a number of rounds logarithmic in the diameter. Each round is written to the
    shared folder; only a count and a checksum reach the driver.
    """
    stars = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars")
    seen = None
    for _ in range(most_rounds):
        both = stars.union(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        stars = cut(small.where("a <> b").distinct(), "stars")
        now = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).union(stars.select("b", "b").distinct())


def near_duplicates(docs: DataFrame, shingle: int = 3, budget: int = BUDGET, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    Texts whose fingerprints differ in at most ``budget`` bits are linked, and component_id is the smallest doc_id that
    links reach (null ids count last). Null and empty texts have fingerprint zero and are linked like any other. Repeated
    rows are each listed; an empty table gives an empty result.
    """
    hashed = cut(simhash(docs, shingle, id_col, text_col).drop("fp2"), "simhash")
    distinct = cut(hashed.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    groups = components(links(distinct, budget))
    rooted = distinct.join(groups, distinct["fp"] == groups["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = cut(rooted, "simhash-roots")
    linked = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = rooted.join(linked, "root").select("fp", "component_id")
    joined = hashed.join(by_print, "fp")  # one row per distinct fingerprint on the right; AQE splits a hot one
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Near duplicates by shingle similarity: tries and shared shingles find candidates, the whole sets decide.

#: Words of a shingle under the candidates' fingerprints. An edited word changes two such shingles, where it changes five
#: of five words, so texts at a Jaccard similarity of 0.8 of the latter differ in some six of 64 bits.
CANDIDATE_SHINGLE = 2
#: Tries over each of two fingerprints, bits of the path into them, bits that may differ below, and in the other fingerprint.
TRIES, PATH_BITS, TRIE_BUDGET, OTHER_BUDGET = 10, 16, 12, 18
#: Texts of one task and path that are so near are first linked to this many of their nearest each; prefixes find the rest.
NEAREST = 32
#: Bits of a set's parity, powers of two: at least and at most. Between them as many as members, or up to twice as many.
SKETCH_BITS, MOST_SKETCH_BITS = 1024, 1 << 15
#: Bytes that a slice of pairs moves in one join: so many for each shingle of the input (about half of its Parquet), and at least.
MOVED, LEAST_MOVED = 2, 1 << 28
#: Most keys that are told to all tasks to find their texts; more are joined, a slice of the texts at a time.
TOLD, TEXT_SLICES = 1 << 17, 4
#: Documents read to learn which shingles are frequent, documents of these that make one so, and most that are told.
SAMPLE, FREQUENT, MOST_FREQUENT = 20_000, 4, 1 << 16
#: Pairs of rows with one shingle that are compared at once; rows of a shingle that are compared along with other shingles'.
BLOCK, FEW = 1 << 20, 8


def _orders() -> list[np.ndarray]:
    """Bit orders of the tries: the path's bits, then the rest; every bit is on two or three paths."""
    rng = np.random.default_rng(5)
    out, pool = [], []
    for _ in range(TRIES):
        if len(pool) < PATH_BITS:
            pool = pool + [b for b in rng.permutation(64).tolist() if b not in pool]
        path, pool = pool[:PATH_BITS], pool[PATH_BITS:]
        out.append(np.array(path + [b for b in range(63, -1, -1) if b not in path]))
    return out


def _spread_wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = [batch.column(c).to_numpy().view(np.uint64) for c in (0, 1)]
        for which in (0, 1):
            for choice, order in enumerate(_orders()):
                start = _permuted(prints[which], order) >> np.uint64(64 - PATH_BITS)
                path = start + np.uint64((which * TRIES + choice) << PATH_BITS)
                yield pa.record_batch([pa.array(path.astype(np.int64)), *batch.columns], names=["path", "fp", "fp2"])


class _Nearest:
    """Pairs that a trie finds, each end's nearest few at a time."""

    def __init__(self, most: int) -> None:
        self.most = most
        self.kept = np.zeros((3, 0), np.int64)
        self.label = np.zeros(0)

    def add(self, i: np.ndarray, j: np.ndarray, apart: np.ndarray) -> None:
        self.kept = np.concatenate([self.kept, np.stack([i, j, apart])], axis=1)
        if self.kept.shape[1] > 1 << 20:
            self.thin()

    def thin(self) -> np.ndarray:
        """Keeps pairs that are among the nearest of either end."""
        keep = np.zeros(self.kept.shape[1], bool)
        for end in (0, 1):
            order = np.lexsort((self.kept[2], self.kept[end]))
            ends = self.kept[end][order]
            nth = np.arange(len(ends)) - np.searchsorted(ends, ends)
            keep[order[nth < self.most]] = True
        self.kept = self.kept[:, keep]
        return self.kept


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    orders = _orders()
    for path, fp, fp2 in _grouped(batches, 3):
        if len(fp) < 2:
            continue
        which, choice = divmod(int(path[0]) >> PATH_BITS, TRIES)
        searched, other = (fp, fp2) if which == 0 else (fp2, fp)
        keys = _permuted(searched.view(np.uint64), orders[choice])
        order = np.argsort(keys, kind="stable")
        pairs = _Nearest(NEAREST)
        trie_links(keys[order], PATH_BITS, TRIE_BUDGET, others=other.view(np.uint64)[order], confirm=OTHER_BUDGET, pairs=pairs)
        i, j, _ = pairs.thin()
        if len(i):
            yield pa.record_batch([pa.array(x[order[k]]) for k in (i, j) for x in (fp, fp2)], names=["a", "a2", "b", "b2"])


class _Sets:
    """What two sets at a Jaccard similarity of ``threshold`` must have in common."""

    def __init__(self, threshold: float) -> None:
        self.threshold = threshold
        self.both = threshold / (1 + threshold)

    def least(self, sizes: np.ndarray) -> np.ndarray:
        """Members that two sets of these sizes, added up, share."""
        return np.ceil(sizes * self.both - 1e-9)

    def prefix(self, n: int) -> int:
        """Members, in any order that all sets keep, among which the first shared one is."""
        return n - max(1, math.ceil(n * self.threshold - 1e-9)) + 1

    def short_prefix(self, n: np.ndarray) -> np.ndarray:
        """The same for the smaller set of a pair."""
        return n - np.maximum(1, self.least(2 * n)) + 1


def shingle_hashes(text: bytes, shingle: int, seed: int = 42) -> np.ndarray:
    return _hashes(text.lower().split() or [b""], shingle, seed)


def _sample(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                found = np.concatenate([np.unique(shingle_hashes(t, shingle)) for t in texts(batch.slice(at, 200))])
                yield pa.record_batch([pa.array(found.view(np.int64))], names=["token"])

    return run


def _frequent(source: DataFrame, shingle: int) -> np.ndarray:
    """Shingles of several sampled documents, from the rarest on. They go last in the order of shingles; any order gives
    the same links, this one fewer candidates."""
    some = max(1, source.count() // SAMPLE)
    tokens = source.where(F.pmod("key", F.lit(some)) == 0).select("key", "text").mapInArrow(_sample(shingle), "token long")
    counts = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= FREQUENT)
    found = counts.orderBy(F.desc("n"), "token").limit(MOST_FREQUENT).collect()
    return np.array([r["token"] for r in reversed(found)], np.int64).view(np.uint64)


def _parity(members: np.ndarray) -> bytes:
    """Of how many members each residue of the hash is that of, but for multiples of two."""
    bits = min(MOST_SKETCH_BITS, max(SKETCH_BITS, 1 << (len(members) - 1).bit_length()))
    return np.packbits((np.bincount((members & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def _wide_prints(shingle: int, rules: _Sets, frequent: np.ndarray):
    """Fingerprints for the tries; key, size, parity bits and prefix of the set of shingles."""
    places = np.argsort(frequent)
    known = frequent[places]

    def one(text: bytes) -> tuple:
        fp, fp2 = fingerprints(text, CANDIDATE_SHINGLE, second=True)
        members = np.unique(shingle_hashes(text, shingle))
        raw = members.tobytes()
        parity = _parity(members)
        ordered = members
        if len(known):
            at = np.minimum(np.searchsorted(known, members), len(known) - 1)
            late = known[at] == members
            ordered = np.concatenate([members[~late], frequent[np.sort(places[at[late]])]])
        return fp, fp2, xxhash.xxh64_intdigest(raw, 0), xxhash.xxh64_intdigest(raw, 1), len(members), parity, ordered[: rules.prefix(len(members))].view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                fp, fp2, set1, set2, n, parity, prefix = zip(*map(one, texts(part)))
                numbers = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (fp, fp2, set1, set2)]
                arrays = [part.column(0), part.column(2), *numbers, pa.array(n, pa.int64()), pa.array(parity, pa.binary()), pa.array(prefix, pa.list_(pa.int64()))]
                yield pa.record_batch(arrays, names=["key", "doc_id", "fp", "fp2", "set1", "set2", "n", "parity", "prefix"])

    return run


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Whole runs of rows (token, key, root, s), sorted by token and root, that hold more than one root: the rows of
    several such runs as columns, and the runs' edges."""
    parts: list[np.ndarray] = []

    def crossing(rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        edges = np.concatenate([[0], np.flatnonzero(rows[0, 1:] != rows[0, :-1]) + 1, [rows.shape[1]]])
        lengths = np.diff(edges)
        some = rows[2, edges[:-1]] != rows[2, edges[1:] - 1]
        if some.any():
            yield rows[:, np.repeat(some, lengths)], np.concatenate([[0], np.cumsum(lengths[some])])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([batch.column(c).to_numpy() for c in range(4)])
        parts.append(rows)
        start = int(np.searchsorted(rows[0], rows[0, -1]))  # of the last run, which may go on
        if start or parts[0][0, 0] != rows[0, -1]:
            ended = np.concatenate([*parts[:-1], rows[:, :start]], axis=1)
            yield from crossing(ended)
            parts = [rows[:, start:]]
    if parts:
        yield from crossing(np.concatenate(parts, axis=1))


def _crossing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, _ in _runs(batches):
        yield pa.record_batch([pa.array(rows[c]) for c in (0, 1, 3)], names=["token", "key", "s"])


def _meeting(rules: _Sets, every: bool):
    """Pairs (a the larger set) of different roots that share a token and may be similar, and their sizes' sum; one for two
    roots or ``every``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, edges in _runs(batches):
            lengths = np.diff(edges)
            found = [*few(rows[:, np.repeat(lengths <= FEW, lengths)])]
            for low, high in zip(edges[:-1][lengths > FEW].tolist(), edges[1:][lengths > FEW].tolist()):
                found += many(rows[1:, low:high])
            if found:
                pairs = np.concatenate(found, axis=1)
                yield pa.record_batch([pa.array(x) for x in pairs], names=["a_key", "b_key", "n"])

    def alike(key: np.ndarray, root: np.ndarray, s: np.ndarray, b, a) -> np.ndarray:
        n, at = s >> 32, s & ((1 << 32) - 1)
        rest = n - at
        near = (root[b] != root[a]) & ((n[b] < n[a]) | ((n[b] == n[a]) & (key[b] < key[a]))) & (n[b] >= n[a] * rules.threshold - 1e-9)
        return near & (at[b] < rules.short_prefix(n[b])) & (np.minimum(rest[b], rest[a]) >= rules.least(n[b] + n[a]))

    def few(rows: np.ndarray) -> Iterator[np.ndarray]:
        """Every pair of rows of short runs, whatever their roots."""
        token, key, root, s = rows
        for apart in range(1, FEW):
            one = np.flatnonzero(token[apart:] == token[:-apart])
            for a, b in ((one, one + apart), (one + apart, one)):
                near = alike(key, root, s, b, a)
                yield np.stack([key[a[near]], key[b[near]], (s[a[near]] >> 32) + (s[b[near]] >> 32)])

    def many(rows: np.ndarray) -> Iterator[np.ndarray]:
        key, root, s = rows
        n, at = s >> 32, s & ((1 << 32) - 1)
        short = np.flatnonzero(at < rules.short_prefix(n))
        step = max(1, BLOCK // len(key))
        for low in range(0, len(short), step):
            b = short[low : low + step]
            i, j = np.nonzero(alike(key, root, s, b[:, None], np.arange(len(key))))
            if not len(i):
                continue
            i = b[i]
            if not every:
                ends = np.sort(np.stack([root[i], root[j]]), axis=0)
                _, one = np.unique(ends, axis=1, return_index=True)
                i, j = i[one], j[one]
            yield np.stack([key[j], key[i], n[j] + n[i]])

    return run


def _parity_allows(rules: _Sets):
    """Pairs whose parity bits differ in no more places than similar sets' members. The longer parity of two folds into
    the shorter one's length. A parity much shorter than its set would let chance pairs pass."""

    def apart(a: list[bytes], b: list[bytes]) -> np.ndarray:
        out = np.zeros(len(a), np.int64)
        lengths = np.array([list(map(len, a)), list(map(len, b))])
        for la, lb in np.unique(lengths, axis=1).T.tolist():
            rows = np.flatnonzero((lengths[0] == la) & (lengths[1] == lb))
            least = min(la, lb) // 8
            for at in range(0, len(rows), 1000):
                part = rows[at : at + 1000].tolist()
                folded = [np.bitwise_xor.reduce(np.frombuffer(b"".join(x[i] for i in part), np.uint64).reshape(len(part), -1, least), axis=1) for x in (a, b)]
                out[part] = np.bitwise_count(folded[0] ^ folded[1]).sum(axis=1, dtype=np.int64)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a_n, b_n = (batch.column(c).to_numpy() for c in (2, 3))
            passed = (apart(batch.column(4).to_pylist(), batch.column(5).to_pylist()) <= a_n + b_n - 2 * rules.least(a_n + b_n)) & (np.minimum(a_n, b_n) >= np.maximum(a_n, b_n) * rules.threshold - 1e-9)
            yield pa.record_batch([batch.column(c).filter(pa.array(passed)) for c in (0, 1)] + [pa.array((a_n + b_n)[passed])], names=["a_key", "b_key", "n"])

    return run


def _sliced(pairs: DataFrame, moved: Column, at_once: int, step: Callable[[Callable[[str], Column]], DataFrame], name: str) -> DataFrame:
    """``step`` of the pairs, in as many slices by ``a_key`` as keep what a slice moves near ``at_once`` bytes, so that disk
    does not grow with the pairs. ``step`` gets a condition on a key, ``moved`` the bytes of a pair."""
    slices = -(-int(pairs.agg(F.sum(moved)).first()[0] or 0) // at_once) or 1
    within = lambda i: lambda key: F.pmod(F.xxhash64(key), F.lit(slices)) == i
    return reduce(DataFrame.union, [cut(step(within(i)), name) for i in range(slices)])


def _shingle_sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                sets = [np.unique(shingle_hashes(t, shingle)).view(np.int64) for t in texts(part)]
                yield pa.record_batch([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["key", "shingles"])

    return run


def near_by_shingles(docs: DataFrame, shingle: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, kept) per distinct document: key is xxhash64 of id and text, see ``common.document_key``; of each group that links
    connect, the smallest id stays (null ids last, then the smallest key).

    Texts are linked at a Jaccard similarity of ``threshold`` of their sets of ``shingle`` words, lower-cased; no such
    link between groups is lost. Most come from tries over two 64-bit SimHashes, twenty in all, each behind a path of 16
    bits, where a text meets its nearest. What tries leave apart meets by shared shingles of the sets' prefixes (all
    sets in one order, sizes and places bound what two can share): first one pair of two groups at each shingle, then
    every pair of groups that are still apart. Parity bits of the sets rule pairs out, whole sets decide, both for a slice
    of the pairs at a time, so that their shuffles do not pile up. Equal sets meet
    by their smallest key alone. Fewer words than a shingle make one shingle of all; texts without words are equal to each
    other. Repeated rows are one document. An empty table gives none.
    """
    rules = _Sets(threshold)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    source = docs.select(document_key(id_col, text_col).alias("key"), text.alias("text"), F.col(id_col).cast("long").alias("doc_id"))
    prints = source.select("key", "text", "doc_id").mapInArrow(_wide_prints(shingle, rules, _frequent(source, shingle)), "key long, doc_id long, fp long, fp2 long, set1 long, set2 long, n long, parity binary, prefix array<long>")
    prints = cut(prints, "near-prints")
    slim = cut(prints.select("key", "doc_id", "fp", "fp2", "set1", "set2", "n", "parity").dropDuplicates(["key"]), "near-slim")
    equal = slim.join(slim.groupBy("set1", "set2").agg(F.min("key").alias("least"), F.count(F.lit(1)).alias("same")).where("same > 1"), ["set1", "set2"]).where("key <> least")
    equal = cut(equal.select(F.col("key").alias("a"), F.col("least").alias("b")), "near-equal")
    single = slim.join(equal.select(F.col("a").alias("key")), "key", "left_anti")
    distinct = single.groupBy("fp", "fp2").agg(F.min(F.struct("key", "n")).alias("least"), F.count(F.lit(1)).alias("same"))
    distinct = cut(distinct.select("fp", "fp2", F.col("least.key").alias("first"), F.col("least.n").alias("first_n"), "same"), "near-distinct")
    found = distinct.select("fp", "fp2").mapInArrow(_spread_wide, "path long, fp long, fp2 long").repartition("path").sortWithinPartitions("path")
    found = found.mapInArrow(_candidates, "a long, a2 long, b long, b2 long").distinct()
    one, other = (distinct.select(F.col("fp").alias(x), F.col("fp2").alias(f"{x}2"), F.col("first").alias(f"{x}_key"), F.col("first_n").alias(f"{x}_n")) for x in "ab")
    pairs = found.join(one, ["a", "a2"]).join(other, ["b", "b2"]).select("a_key", "b_key", (F.col("a_n") + F.col("b_n")).alias("n"))
    alike = single.join(distinct.where("same > 1").select("fp", "fp2", "first", "first_n"), ["fp", "fp2"]).where("key <> first").select(F.col("first").alias("a_key"), F.col("key").alias("b_key"), (F.col("n") + F.col("first_n")).alias("n"))
    at_once = max(LEAST_MOVED, MOVED * (slim.agg(F.sum("n")).first()[0] or 0))

    def sets_of(wanted: DataFrame) -> DataFrame:
        """key, shingles of the wanted texts."""
        texts_ = source.select("key", "text")
        whole = lambda rows: cut(rows.dropDuplicates(["key"]).mapInArrow(_shingle_sets(shingle), "key long, shingles array<long>"), "near-sets")
        if wanted.count() <= TOLD:
            return whole(texts_.join(F.broadcast(wanted), "key", "left_semi"))
        mine = lambda df, i: df.where(F.pmod("key", F.lit(TEXT_SLICES)) == i)
        return reduce(DataFrame.union, [whole(mine(texts_, i).join(mine(wanted, i), "key", "left_semi")) for i in range(TEXT_SLICES)])

    def linked(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that are similar, of pairs with their sizes' sum."""
        pairs = cut(pairs, "near-met")
        a, b = (slim.select(*[F.col(c).alias(f"{x}_{c}") for c in ("key", "n", "parity")]) for x in "ab")

        def possible(mine: Callable[[str], Column]) -> DataFrame:
            rows = pairs.where(mine("a_key")).select("a_key", "b_key").join(a.where(mine("a_key")), "a_key").join(b, "b_key")
            return rows.select("a_key", "b_key", "a_n", "b_n", "a_parity", "b_parity").mapInArrow(_parity_allows(rules), "a_key long, b_key long, n long")

        near = _sliced(pairs, F.col("n") / 8 + SKETCH_BITS / 8, at_once, possible, "near-pairs")
        discard(pairs)
        sets = sets_of(cut(near.select(F.col("a_key").alias("key")).union(near.select("b_key")).distinct(), "near-wanted"))
        a_sets, b_sets = (sets.select(F.col("key").alias(f"{x}_key"), F.col("shingles").alias(f"{x}_set")) for x in "ab")
        shared = F.size(F.array_intersect("a_set", "b_set"))
        sizes = F.size("a_set") + F.size("b_set")

        def similar(mine: Callable[[str], Column]) -> DataFrame:
            rows = near.where(mine("a_key")).join(a_sets.where(mine("a_key")), "a_key").join(b_sets, "b_key")
            return rows.where(shared * (1 + threshold) >= sizes * threshold - 1e-9).select(F.col("a_key").alias("a"), F.col("b_key").alias("b"))

        met = _sliced(near, F.col("n") * 4 + 32, at_once, similar, "near-links")
        discard(sets)
        return met

    links_ = linked(pairs.union(alike)).union(equal)
    groups = components(links_)
    rooted = prints.select("key", "n", "prefix").join(equal.select(F.col("a").alias("key")), "key", "left_anti")
    rooted = rooted.join(groups.withColumnRenamed("node", "key"), "key", "left").select("key", F.coalesce("root", "key").alias("root"), "n", F.posexplode("prefix").alias("at", "token"))
    rows = rooted.select("token", "key", "root", F.shiftleft("n", 32).bitwiseOR(F.col("at").cast("long")).alias("s"))
    rows = cut(rows.repartition("token").sortWithinPartitions("token", "root").mapInArrow(_crossing, "token long, key long, s long"), "near-crossing")
    discard(prints)
    for every in (False, True):
        now = rows.join(groups.withColumnRenamed("node", "key"), "key", "left").select("token", "key", F.coalesce("root", "key").alias("root"), "s")
        met = now.repartition("token").sortWithinPartitions("token", "root").mapInArrow(_meeting(rules, every), "a_key long, b_key long, n long")
        more = linked(met.distinct())
        if not more.isEmpty():
            links_ = links_.union(more)
            groups = components(links_)
    placed = slim.select("key", "doc_id").join(groups.withColumnRenamed("node", "key"), "key")
    best = placed.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("best"))
    kept = placed.join(best, "root").select("key", (F.col("key") == F.col("best.key")).alias("stays"))
    return slim.select("key").join(kept, "key", "left").select("key", F.coalesce("stays", F.lit(True)).alias("kept"))
