"""Best-two-fit packing of tokenised documents into fixed-length sequences.

Lengths are integers up to the sequence length, so the packing plan needs only how many pieces there are of each length:
a table of at most ``capacity`` numbers, whatever the corpus. The driver packs that histogram: fill a bin greedily with
the longest piece that fits, then replace its smallest piece by the two unpacked pieces that fit the widened gap best. As
long as supplies last, the next bin would come out the same, so one pattern is laid down as often as they allow; the
result equals packing bin by bin. Pieces then find their slot from their length and their rank among equal lengths,
which comes from counts per partition; no document is sorted or gathered anywhere.
"""

from __future__ import annotations

import bisect
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemolake.llm.common import LONGEST_KEPT, cut, sliced

CAPACITY = 4096
TOKENIZER = "word_bpe_49k.json"
#: Words whose ids a Python worker remembers in a task, about 200 bytes each.
CACHE_WORDS = 400_000


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordTokenizer:
    """Token ids of whole texts, word by word with a bounded memory of words.

    For a tokenizer that drops white space, splits letters from everything else and never merges across a split, the ids
    of a text are those of its words in turn, and those of a word before a full stop or comma are the word's and then the
    mark's, where the word ends in a Latin letter that normalisation leaves a letter (``tests/llm`` compares every letter
    with the tokenizer itself). Words of plain Latin letters go straight to the vocabulary's merges; everything else takes
    the tokenizer's own way, as do all texts where the tokenizer's file is not made of these very parts.
    """

    _known: dict[str, WordTokenizer] = {}

    def __init__(self, path: str, cache_words: int = CACHE_WORDS) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_word = _parts(json.loads(self.tokenizer.to_str())) == _PARTS
        self.model = self.tokenizer.model
        self.half = cache_words // 2
        # Two generations: what the younger lacks is taken over from the older, which is dropped when the younger is full.
        self.forget()
        self.marks = {mark: self._whole(mark) for mark in ".,"}
        self.letters = {chr(c): "".join(map(_BYTE_LETTERS.__getitem__, chr(c).encode())) for c in range(0x80, 0x250)}

    def forget(self) -> None:
        """Empty the memory of words, so that a worker's next task, of whatever stage, finds its memory free."""
        self.young, self.old = {"": b""}, {}

    @classmethod
    def of(cls, path: str) -> WordTokenizer:
        """The worker's own, kept between tasks."""
        if path not in cls._known:
            cls._known[path] = cls(path)
        return cls._known[path]

    def _whole(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, word: str) -> bytes:
        found = self.old.get(word)
        if found is None:
            if word[-1] in ".," and len(word) > 1 and word[-2].isalnum() and word[-2] < "\u0250" and word[-2] != "\u0130":
                found = (self.young.get(word[:-1]) or self._learn(word[:-1])) + self.marks[word[-1]]
            elif word.isalpha() and max(word) < "\u0250" and "\u0130" not in word:
                low = word.lower()
                if low != word:
                    found = self.young.get(low) or self._learn(low)
                else:
                    if not low.isascii():
                        low = "".join([c if c < "\x80" else self.letters[c] for c in low])
                    found = np.array([t.id for t in self.model.tokenize(low)], "<u4").tobytes()
            else:
                found = self._whole(word)
        if len(word) <= LONGEST_KEPT:
            self.young[word] = found
        return found

    def ids(self, text: str) -> np.ndarray:
        if not self.by_word:
            return np.frombuffer(self._whole(text), "<u4")
        words = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ")
        if len(self.young) > self.half:
            self.old, self.young = self.young, {"": b""}
        known, learn = self.young.get, self._learn
        return np.frombuffer(b"".join([w if (w := known(word)) is not None else learn(word) for word in words]), "<u4")


def _parts(described: dict) -> dict:
    """What of a tokenizer's file decides whether words can be taken one by one."""
    normalizer, splitter, model = (described.get(k) or {} for k in ("normalizer", "pre_tokenizer", "model"))
    return {
        "normalizers": [(n.get("type"), n.get("pattern"), n.get("content")) for n in normalizer.get("normalizers", [])],
        "splits": [(p.get("type"), p.get("pattern"), p.get("behavior"), p.get("invert"), p.get("add_prefix_space"), p.get("use_regex")) for p in splitter.get("pretokenizers", [])],
        "model": [model.get(k) for k in ("type", "dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")],
        "added": sorted((t.get("content"), bool(t.get("normalized"))) for t in described.get("added_tokens", [])),
    }


#: NFC, white space to a space, lower case; letters, single digits and other signs apart; byte-level BPE with word ends.
_PARTS = {
    "normalizers": [("NFC", None, None), ("Replace", {"Regex": "\\s+"}, " "), ("Lowercase", None, None)],
    "splits": [
        ("Split", {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "Removed", True, None, None),
        ("ByteLevel", None, None, None, False, False),
    ],
    "model": ["BPE", None, None, None, "</w>", False, False, False],
    "added": [("<|endoftext|>", False), ("<|startoftext|>", False)],
}


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b if b in own else next(others)) for b in range(256)]


_BYTE_LETTERS = _byte_letters()


def _pieces(path: str, capacity: int, end_id: int, with_ids: bool):
    def cut_up(tokenizer: WordTokenizer, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ranks = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        end = np.array([end_id], "<u4")
        for batch in sliced(batches):
            at, piece, start, length, crc, rank, ids = [], [], [], [], [], [], []
            for row, text in enumerate(batch.column(1)):
                codes = np.concatenate([tokenizer.ids(text.as_py() or ""), end])
                for k, a in enumerate(range(0, len(codes), capacity)):
                    raw = codes[a : a + capacity].tobytes()
                    n = len(raw) // 4
                    at.append(row), piece.append(k), start.append(a), length.append(n), crc.append(zlib.crc32(raw)), rank.append(ranks[n])
                    ranks[n] += 1
                    if with_ids:
                        ids.append(raw)
            columns = [
                batch.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                pa.array(crc, pa.int64()), pa.array([part] * len(at), pa.int32()), pa.array(rank, pa.int64()), *([pa.array(ids, pa.binary())] if with_ids else []),
            ]
            yield pa.record_batch(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank", *(["ids"] if with_ids else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = WordTokenizer.of(path)
        try:
            yield from cut_up(tokenizer, batches)
        finally:
            tokenizer.forget()

    return run


def pack_histogram(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """(times, lengths from the longest down) for every pattern laid down, all pieces used exactly once."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    lengths = sorted(length for length, n in counts.items() if n)
    plan = []
    while lengths:
        used: dict[int, int] = {}
        pattern, gap = [], capacity

        def free(length: int) -> int:
            return int(left[length]) - used.get(length, 0)

        top = len(lengths)
        while gap:
            at = min(top, bisect.bisect_right(lengths, gap)) - 1
            while at >= 0 and free(lengths[at]) <= 0:
                at -= 1
            if at < 0:
                break
            length, top = lengths[at], at + 1
            take = min(gap // length, free(length))
            used[length] = used.get(length, 0) + take
            pattern += [length] * take
            gap -= take * length
        if gap and len(pattern) > 1:
            small, wide = pattern[-1], gap + pattern[-1]
            pair = _best_pair(lengths, free, wide)
            if pair and sum(pair) > small:
                pattern = sorted([*pattern[:-1], *pair], reverse=True)
        need = {length: pattern.count(length) for length in set(pattern)}
        times = min(int(left[length]) // n for length, n in need.items())
        plan.append((times, pattern))
        for length, n in need.items():
            left[length] -= n * times
            if not left[length]:
                lengths.remove(length)
    return plan


def _best_pair(lengths: list[int], free, wide: int) -> tuple[int, int] | None:
    """The two unused pieces with the largest sum up to ``wide``."""
    best, low, high = None, 0, bisect.bisect_right(lengths, wide - 1) - 1
    while low <= high:
        a, b = lengths[low], lengths[high]
        if free(b) <= 0 or a + b > wide or (low == high and free(a) < 2):
            high -= 1
        elif free(a) <= 0:
            low += 1
        else:
            if best is None or a + b > sum(best):
                best = (a, b)
                if a + b == wide:
                    break
            low += 1
    return best


def slots(plan: list[tuple[int, list[int]]]) -> dict[int, np.ndarray]:
    """By length: rows (first rank, pieces per bin, first sequence, first offset), in order of ranks."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for times, pattern in plan:
        at = 0
        while at < len(pattern):
            length = pattern[at]
            n = pattern.count(length)
            rank = ranks.get(length, 0)
            rows.setdefault(length, []).append((rank, n, sequence, sum(pattern[:at])))
            ranks[length] = rank + n * times
            at += n
        sequence += times
    return {length: np.array(r, np.int64) for length, r in rows.items()}


def _place(where):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = where.value
        for batch in batches:
            length, rank = (batch.column(name).to_numpy() for name in ("length", "rank"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for one in np.unique(length):
                mine, table = length == one, tables[int(one)]
                row = table[np.searchsorted(table[:, 0], rank[mine], side="right") - 1]
                nth = rank[mine] - row[:, 0]
                sequence[mine] = row[:, 2] + nth // row[:, 1]
                offset[mine] = row[:, 3] + nth % row[:, 1] * one
            keep = [n for n in batch.schema.names if n != "rank"]
            yield pa.record_batch([*(batch.column(n) for n in keep), pa.array(sequence), pa.array(offset)], names=[*keep, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = 1, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ids (little-endian unsigned
    32-bit) on request.

    A document is its token ids and then ``end_id``; null and empty texts are that one id. Documents longer than
    ``capacity`` are cut into pieces of that length and a rest. Repeated rows are pieces of their own; an empty table
    gives an empty result.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    fields = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long" + (", ids binary" if with_ids else "")
    pieces = cut(source.mapInArrow(_pieces(path or tokenizer_path(), capacity, end_id, with_ids), fields), "pack-pieces")
    spark = docs.sparkSession
    # At most `capacity` rows reach the driver.
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    where = spark.sparkContext.broadcast(slots(pack_histogram(counts, capacity)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    offsets = offsets.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = pieces.join(offsets, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("before"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    out = "doc_id long, piece int, start long, length long, ids_crc32 long," + (" ids binary," if with_ids else "") + " sequence_id long, offset long"
    return ranked.select(*names, "rank").mapInArrow(_place(where), out)
