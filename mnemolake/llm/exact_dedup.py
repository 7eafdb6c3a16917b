"""Exact deduplication through counting quotient filters.

Each partition builds a counting quotient filter (CQF) of the 64-bit fingerprints of its normalised texts. Filters are
cut by quotient range, and the pieces of one range merge losslessly by walking their sorted remainders. Fingerprints
whose merged count is above one route their documents to byte verification; all others are proven unique.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemolake.llm.common import cut, document_key, texts

_SPACES = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")
#: Copies of the small side of a join on a text's digest, so that one huge group spreads over as many tasks.
SALTS = 16
#: Fingerprints per quotient range that a merging task should meet at most.
SLICE_ROWS = 1 << 20


def normalise(text: bytes) -> bytes:
    """Every run of ASCII white space becomes one space; nothing is stripped."""
    text = text.translate(_SPACES)
    while b"  " in text:
        text = text.replace(b"  ", b" ")
    return text


class CountingQuotientFilter:
    """A static CQF over 64-bit fingerprints that share their top ``slice_bits``.

    The next ``q`` bits are the quotient, the rest the remainder. ``occupied`` has a bit per quotient, ``run_end`` a bit
    per slot; slots hold remainders in (quotient, remainder) order, and counters above one are kept beside their slot.
    Quotient and remainder give back the whole fingerprint, so nothing is lost. Remainders are packed, as many bits each
    as they have.
    """

    def __init__(self, q: int, slice_bits: int, top: int, n: int, occupied, run_end, remainders, extra_at, extra) -> None:
        self.q, self.slice_bits, self.top, self.n = q, slice_bits, top, n
        self.occupied, self.run_end, self.remainders = occupied, run_end, remainders
        self.extra_at, self.extra = extra_at, extra

    @classmethod
    def build(cls, sorted_unique: np.ndarray, counts: np.ndarray, slice_bits: int) -> CountingQuotientFilter:
        n = len(sorted_unique)
        q = min(max(3, int(n - 1).bit_length()), 64 - slice_bits - 1)
        r = np.uint64(64 - slice_bits - q)
        top = int(sorted_unique[0]) >> (64 - slice_bits) if slice_bits else 0
        quotient = (sorted_unique >> r) & np.uint64((1 << q) - 1)
        occupied = np.zeros(1 << q, np.uint8)
        occupied[quotient] = 1
        run_end = np.append(quotient[1:] != quotient[:-1], True).astype(np.uint8)
        extra_at = np.flatnonzero(counts > 1).astype(np.uint32)
        return cls(
            q, slice_bits, top, n, np.packbits(occupied), np.packbits(run_end),
            _packed(sorted_unique, int(r)), extra_at, counts[extra_at].astype(np.uint64),
        )

    def decode(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted fingerprints and their counts."""
        n = self.n
        run_end = np.unpackbits(self.run_end, count=n)
        quotients = np.flatnonzero(np.unpackbits(self.occupied)).astype(np.uint64)
        run = np.cumsum(run_end, dtype=np.int64) - run_end
        r = np.uint64(64 - self.slice_bits - self.q)
        high = np.uint64(self.top << (64 - self.slice_bits)) if self.slice_bits else np.uint64(0)
        counts = np.ones(n, np.uint64)
        counts[self.extra_at] = self.extra
        return high | (quotients[run] << r) | _unpacked(self.remainders, n, int(r)), counts

    @staticmethod
    def merge(filters: list[CountingQuotientFilter]) -> tuple[np.ndarray, np.ndarray]:
        """Counts added up over filters of one quotient range, in fingerprint order.

        Two at a time, shortest first: each walks its remainders along the other's, and equal ones add their counts.
        """
        parts = [(len(f.remainders), i, f.decode()) for i, f in enumerate(filters)]
        heapq.heapify(parts)
        while len(parts) > 1:
            (_, _, one), (_, i, other) = heapq.heappop(parts), heapq.heappop(parts)
            both = _walk(one, other)
            heapq.heappush(parts, (len(both[0]), i, both))
        return parts[0][2]

    def to_bytes(self) -> bytes:
        head = np.array([self.q, self.slice_bits, self.top, self.n, len(self.extra_at)], np.uint64)
        return b"".join(x.tobytes() for x in (head, self.occupied, self.run_end, self.remainders, self.extra_at, self.extra))

    @classmethod
    def from_bytes(cls, data: bytes) -> CountingQuotientFilter:
        q, slice_bits, top, n, m = (int(x) for x in np.frombuffer(data, np.uint64, 5))
        at = 40
        out = []
        r = 64 - slice_bits - q
        for dtype, size in ((np.uint8, (1 << q) // 8), (np.uint8, (n + 7) // 8), (np.uint8, (n * r + 7) // 8), (np.uint32, m), (np.uint64, m)):
            out.append(np.frombuffer(data, dtype, size, at))
            at += size * np.dtype(dtype).itemsize
        return cls(q, slice_bits, top, n, *out)


def _packed(values: np.ndarray, bits: int) -> np.ndarray:
    """The low ``bits`` of every value, one behind the other."""
    out = np.zeros(0, np.uint8)
    parts = []
    step = 1 << 16  # a multiple of eight values ends on a whole byte
    for at in range(0, len(values), step):
        wide = np.unpackbits(values[at : at + step].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        parts.append(np.packbits(wide[:, 64 - bits :].ravel()))
    return np.concatenate(parts) if parts else out


def _unpacked(packed: np.ndarray, n: int, bits: int) -> np.ndarray:
    out = np.zeros(n, np.uint64)
    step = 1 << 16
    for at in range(0, n, step):
        some = min(step, n - at)
        raw = np.unpackbits(packed[at * bits // 8 : (at + some) * bits // 8 + 1], count=some * bits).reshape(some, bits)
        wide = np.zeros((some, 64), np.uint8)
        wide[:, 64 - bits :] = raw
        out[at : at + some] = np.packbits(wide, axis=1).view(">u8").ravel()
    return out


def _walk(one: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two sorted runs without repeats as one, counts of what both hold added."""
    (a, a_n), (b, b_n) = one, other
    at = np.searchsorted(a, b)
    held = np.zeros(len(b), bool)
    inside = at < len(a)
    held[inside] = a[at[inside]] == b[inside]
    a_n = a_n.copy()
    a_n[at[held]] += b_n[held]
    return np.insert(a, at[~held], b[~held]), np.insert(a_n, at[~held], b_n[~held])


def _meta(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fingerprints, digests = [], []
        for text in texts(batch):
            text = normalise(text)
            fingerprints.append(xxhash.xxh3_64_intdigest(text))
            digests.append(hashlib.sha256(text).hexdigest())
        yield pa.record_batch(
            [batch.column(0), pa.array(np.array(fingerprints, np.uint64).view(np.int64)), pa.array(digests, pa.string()), *batch.columns[2:]],
            names=["doc_id", "fingerprint", "text_sha256", *batch.schema.names[2:]],
        )


def _build(slice_bits: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for batch in batches:
            parts.append(np.unique(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), return_counts=True))
            if len(parts) > 16:
                parts = [_add(parts)]
        if not parts:
            return
        fingerprints, counts = _add(parts)
        if not len(fingerprints):
            return
        top = fingerprints >> np.uint64(64 - slice_bits) if slice_bits else np.zeros(len(fingerprints), np.uint64)
        edges = [0, *(np.flatnonzero(top[1:] != top[:-1]) + 1).tolist(), len(top)]
        slices = [int(top[a]) for a in edges[:-1]]
        filters = [CountingQuotientFilter.build(fingerprints[a:b], counts[a:b], slice_bits).to_bytes() for a, b in zip(edges, edges[1:])]
        yield pa.record_batch([pa.array(slices, pa.int64()), pa.array(filters, pa.binary())], names=["slice", "filter"])

    return build


def _add(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    fingerprints, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return fingerprints, np.bincount(at, np.concatenate([p[1] for p in parts]), len(fingerprints)).astype(np.uint64)


def _merge(table: pa.Table) -> pa.Table:
    filters = [CountingQuotientFilter.from_bytes(x.as_py()) for x in table.column("filter")]
    fingerprints, counts = CountingQuotientFilter.merge(filters)
    again = counts > 1
    return pa.table({"fingerprint": fingerprints[again].view(np.int64), "n": counts[again].astype(np.int64)})


def repeated_fingerprints(meta: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """(fingerprint, n) of every fingerprint that occurs more than once in ``meta``."""
    slice_bits = max(4, (max(meta.count(), 1) // slice_rows).bit_length())
    filters = meta.select("fingerprint").mapInArrow(_build(slice_bits), "slice long, filter binary")
    return filters.groupBy("slice").applyInArrow(_merge, "fingerprint long, n long")


def _salted(df: DataFrame) -> DataFrame:
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def normal(text: Column) -> Column:
    """``normalise`` as a column, null as empty."""
    return F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     "), " {2,}", " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_key: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256; and key on request, 64 bits of id and
    text (``common.document_key``).

    Null text counts as empty. Texts are equal when identical after replacing each run of ASCII white space by one
    space. The smallest doc_id of equal texts stays (null ids last); of repeated rows with that id, exactly one stays.
    An empty table gives an empty result.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if with_key:
        source = source.withColumn("key", document_key())
    meta = source.mapInArrow(_meta, "doc_id long, fingerprint long, text_sha256 string" + (", key long" if with_key else ""))
    salt = F.pmod(F.xxhash64("doc_id", "row"), F.lit(SALTS)).cast("int")
    meta = cut(meta.withColumn("row", F.monotonically_increasing_id()).withColumn("salt", salt), "dedup-meta")

    routed = meta.join(_salted(repeated_fingerprints(meta)), ["fingerprint", "salt"], "left_semi").select("doc_id").distinct()
    # Joined by id, copies of one text stay spread over all tasks; each task then sends every distinct text once.
    suspects = source.join(routed.withColumnRenamed("doc_id", "routed_id"), F.col("doc_id").eqNullSafe(F.col("routed_id")), "left_semi")
    verified = (
        suspects.groupBy(normal(F.col("text")).alias("normal")).agg(F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
        .select(F.sha2("normal", 256).alias("text_sha256"), "group_size")
    )
    groups = cut(verified, "dedup-groups")
    in_groups = meta.join(_salted(groups.select("text_sha256")), ["text_sha256", "salt"], "left_semi")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    keep = in_groups.groupBy("text_sha256").agg(first).join(groups, "text_sha256")
    keep = keep.select("text_sha256", F.col("first.doc_id").alias("keep"), F.col("first.row").alias("keep_row"), "group_size")
    joined = meta.join(_salted(keep), ["text_sha256", "salt"], "left")
    alone = F.col("keep_row").isNull()
    return joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"),
        "text_sha256",
        *(["key"] if with_key else []),
    )
