"""Substring deduplication: suffix automata of reference shards and the matching statistics of documents.

A window is ``window`` consecutive words; its words go when the same sequence of words also starts anywhere else. Automata
of the whole corpus grow with it and cannot be broadcast, and to broadcast them in turn would read the corpus once per
shard. So references are sharded by content, and an automaton stands where its shard and all that can match it lie: each
window belongs to the anchor in it, the word group of smallest hash, and equal windows have equal anchors. Runs of windows
with one anchor occurrence are segments, and only segments whose anchor occurs again can match.

The distinct segments of an anchor, with how often each occurs, are a shard of bounded size: a suffix automaton of them is
built, each segment streams through it, and a state that holds its last ``window`` words and ends more than once marks a
repeated window. All results come from automata. A shard of more than ``shard_segments`` segments is sharded again by
longer anchors, up to whole windows, where a shard is one segment.

Words are compared by 64-bit hashes in the automata, segments are told apart by 128 bits; texts move once per join and
only marked ranges come back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemolake.llm.common import cut, discard, texts

WINDOW, ANCHOR = 35, 8
#: Distinct segments of one automaton; larger shards are parted by longer anchors.
SHARD_SEGMENTS = 512
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n."""
    if len(_POWERS.get("up", ())) < n:
        size = 1 << max(12, (n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Hashes:
    """Hashes of a text's words, and of any run of them."""

    def __init__(self, words: np.ndarray) -> None:
        self.words, n = words, len(words)
        self.up, down = _powers(n + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * down[:n], dtype=np.uint64)])

    def run(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.up[start] + (end - start).astype(np.uint64))


def word_hashes(text: bytes) -> np.ndarray:
    words = text.split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _window_low(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the leftmost smallest value in every run of ``width``."""
    low, at, span = values, np.arange(len(values)), 1
    while span < width:
        step = min(span, width - span)
        left = low[:-step] <= low[step:]
        at = np.where(left, at[:-step], at[step:])
        low = np.where(left, low[:-step], low[step:])
        span += step
    return at


def segments(hashes: Hashes, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """(anchor hash, segment hash, first window, windows) of every run of windows with one anchor occurrence."""
    n = len(hashes.words) - window + 1
    if n <= 0:
        return (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    starts = np.arange(len(hashes.words) - anchor + 1)
    grams = hashes.run(starts, starts + anchor)
    at = _window_low(grams, window - anchor + 1)
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    count = np.diff(np.append(first, n))
    return grams[at[first]], hashes.run(first, first + count + window - 1), first, count


class SuffixAutomaton:
    """A suffix automaton of several word sequences, counting where states end."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.ends = [-1], [0], [0]

    def _state(self, length: int, link: int, following: dict[int, int], ends: int) -> int:
        self.next.append(following), self.link.append(link), self.length.append(length), self.ends.append(ends)
        return len(self.link) - 1

    def add(self, sequence: list[int], times: int = 1) -> None:
        nexts, link, length = self.next, self.link, self.length
        last = 0
        for word in sequence:
            if word in nexts[last]:
                known = nexts[last][word]
                if length[known] != length[last] + 1:
                    known = self._split(last, known, word)
                self.ends[known] += times
                last = known
                continue
            new = self._state(length[last] + 1, 0, {}, times)
            p = last
            while p >= 0 and word not in nexts[p]:
                nexts[p][word] = new
                p = link[p]
            if p >= 0:
                q = nexts[p][word]
                link[new] = q if length[q] == length[p] + 1 else self._split(p, q, word)
            last = new

    def _split(self, p: int, q: int, word: int) -> int:
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]), 0)
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def finish(self) -> SuffixAutomaton:
        """Adds up, from long to short, how often each state's words end."""
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            if self.link[state] > 0:
                self.ends[self.link[state]] += self.ends[state]
        return self

    def repeated(self, sequence: list[int], window: int) -> list[int]:
        """Starts of the windows of ``sequence`` that end more than once in what was added; by matching statistics."""
        out, state, matched = [], 0, 0
        for i, word in enumerate(sequence):
            while state and word not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if word in self.next[state]:
                state, matched = self.next[state][word], matched + 1
            while self.link[state] >= 0 and self.length[self.link[state]] >= window:
                state = self.link[state]
                matched = self.length[state]
            if matched >= window and self.ends[state] > 1:
                out.append(i - window + 1)
        return out


def _anchors(window: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, parts = [], []
            for i, text in enumerate(texts(batch, 2)):
                found = segments(Hashes(word_hashes(text)), window, anchor)
                rows.append(np.full(len(found[0]), i))
                parts.append(found)
            if not rows:
                continue
            at = pa.array(np.concatenate(rows).astype(np.int64))
            a, s, first, count = (np.concatenate([p[k] for p in parts]) for k in range(4))
            yield pa.record_batch(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(a.view(np.int64)), pa.array(s.view(np.int64)), pa.array(first.astype(np.int32)), pa.array(count.astype(np.int32))],
                names=["doc_id", "text_key", "anchor", "segment", "first", "windows"],
            )

    return run


def _fetch(window: int):
    """Word hashes of the segments asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for i, text in enumerate(texts(batch, 2)):
                words = word_hashes(text)
                for w in batch.column(3)[i].as_py():
                    out.append((w["anchor"], w["segment"], w["kinds"], w["times"], words[w["first"] : w["first"] + w["windows"] + window - 1].tobytes()))
                if len(out) > 20_000:
                    yield _rows(out)
                    out = []
            if out:
                yield _rows(out)

    return run


def _rows(out: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["anchor", "segment", "kinds", "times", "words"])


def _parted(window: int, anchor: int):
    """Segments of large shards, cut at the occurrences of longer anchors: which segment, where in it, and the new one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["whole_anchor", "whole", "times", "anchor", "segment", "first", "words"]
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        for batch in batches:
            out: list[tuple] = []
            for old, whole, times, raw in zip(*(batch.column(c).to_pylist() for c in ("anchor", "segment", "times", "words"))):
                code = np.frombuffer(raw, np.uint64)
                for at, part, first, windows in zip(*segments(Hashes(code), window, anchor)):
                    out.append((old, whole, times, int(at.view(np.int64)), int(part.view(np.int64)), int(first), code[first : first + windows + window - 1].tobytes()))
                if len(out) > 20_000:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
                    out = []
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return run


def _runs(starts: list[int], window: int) -> list[tuple[int, int]]:
    """Word ranges that windows at ascending ``starts`` cover."""
    out: list[list[int]] = []
    for s in starts:
        if out and s <= out[-1][1]:
            out[-1][1] = s + window
        else:
            out.append([s, s + window])
    return [(a, b) for a, b in out]


def _match(window: int):
    """Rows come sorted by anchor: one shard after another."""

    def settle(anchor: int, shard: list[tuple]) -> list[tuple]:
        automaton = SuffixAutomaton()
        sequences = [np.frombuffer(s[2], np.uint64).tolist() for s in shard]
        for s, words in zip(shard, sequences):
            automaton.add(words, s[1])
        automaton.finish()
        out = []
        for (segment, _, _), words in zip(shard, sequences):
            out += [(anchor, segment, a, b) for a, b in _runs(automaton.repeated(words, window), window)]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, shard, out = None, [], []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("anchor", "segment", "times", "words")]
            for anchor, *row in zip(*columns):
                if anchor != now:
                    out += settle(now, shard) if shard else []
                    now, shard = anchor, []
                shard.append(tuple(row))
            if len(out) > 20_000:
                yield _ranges(out)
                out = []
        out += settle(now, shard) if shard else []
        if out:
            yield _ranges(out)

    return run


def _ranges(out: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["anchor", "segment", "low", "high"])


def _clean(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, digests, kept_texts = [], [], [], []
            for i, text in enumerate(texts(batch, 2)):
                words = text.split()
                n, gone, at, kept = len(words), 0, 0, []
                for r in sorted((r["low"], r["high"]) for r in batch.column(3)[i].as_py() or ()):
                    low, high = max(r[0], at), r[1]
                    if high > at:
                        kept += words[at:low]
                        gone += high - low
                        at = high
                kept = b" ".join(kept + words[at:] if at else words)
                total.append(n), removed.append(gone), digests.append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    kept_texts.append(kept.decode())
            columns = [batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())]
            yield pa.record_batch(columns + ([pa.array(kept_texts, pa.string())] if with_text else []), names=["doc_id", "n_words", "n_removed", "kept_sha256", *(["text"] if with_text else [])])

    return run


def substring_dedup(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, shard_segments: int = SHARD_SEGMENTS, with_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256, and the cleaned text on request.

    Words are runs of anything but ASCII white space, unchanged; a null text has none. Windows are judged on the input:
    a repeated row repeats all its windows. Texts under ``window`` words stay whole. Null ids are allowed.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    key = "doc_id long, text_key long"
    found = cut(source.mapInArrow(_anchors(window, anchor), f"{key}, anchor long, segment long, first int, windows int"), "sub-anchors")

    again = found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor")
    live = cut(found.join(again, "anchor"), "sub-live")
    discard(found)
    kinds = live.groupBy("anchor", "segment").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("doc_id", "text_key", "first", "windows")).alias("one"))
    kinds = cut(kinds, "sub-kinds")
    shards = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"))
    wanted = kinds.join(shards, "anchor").select("anchor", "segment", "kinds", F.least("times", F.lit(2)).alias("times"), "one.*")
    asked = wanted.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("anchor", "segment", "kinds", "first", "windows", "times")).alias("asked"))
    fetched = _to_docs(source, asked, "inner", "asked").mapInArrow(_fetch(window), "anchor long, segment long, kinds long, times long, words binary")
    # A repeated row is fetched twice; its segments occur twice as they are, so that changes no answer.
    fetched = cut(fetched, "sub-shards")
    spans = _matched(fetched, window, anchor, shard_segments)
    found_spans = cut(spans, "sub-spans")
    ranges = live.join(found_spans, ["anchor", "segment"]).select("doc_id", "text_key", (F.col("first") + F.col("low")).alias("low"), (F.col("first") + F.col("high")).alias("high"))
    marked = cut(ranges.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("low", "high")).alias("ranges")), "sub-ranges")
    for done in (live, kinds, fetched, found_spans):
        discard(done)
    out = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", text string" if with_text else "")
    return _to_docs(source, marked, "left", "ranges").mapInArrow(_clean(with_text), out)


def _matched(fetched: DataFrame, window: int, anchor: int, shard_segments: int) -> DataFrame:
    """(anchor, segment, low, high): ranges of words that repeated windows cover, of segments (anchor, segment, kinds, times,
    words); by automata of shards, and of parts of those that are too large for one."""
    spans = "anchor long, segment long, low int, high int"
    fits = F.col("kinds") <= shard_segments
    small = fetched.where(fits).select("anchor", "segment", "times", "words").repartition("anchor").sortWithinPartitions("anchor")
    matched = small.mapInArrow(_match(window), spans)
    large = fetched.where(~fits)
    if large.isEmpty():
        return matched
    longer = min(2 * anchor, window)
    parts = large.mapInArrow(_parted(window, longer), "whole_anchor long, whole long, times long, anchor long, segment long, first int, words binary")
    parts = cut(parts, "sub-parts")
    kinds = parts.groupBy("anchor", "segment").agg(F.sum("times").alias("times"), F.first("words").alias("words"))
    live = kinds.join(kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.sum("times").alias("all")).where("all > 1"), "anchor")
    live = cut(live.select("anchor", "segment", F.when(F.lit(longer == window), F.lit(1)).otherwise(F.col("kinds")).cast("long").alias("kinds"), F.least("times", F.lit(2)).alias("times"), "words"), "sub-part-shards")
    below = _matched(live, window, longer, shard_segments)
    moved = parts.select("whole_anchor", "whole", "anchor", "segment", "first").join(below, ["anchor", "segment"])
    moved = moved.select(F.col("whole_anchor").alias("anchor"), F.col("whole").alias("segment"), (F.col("first") + F.col("low")).alias("low"), (F.col("first") + F.col("high")).alias("high"))
    return matched.unionByName(moved)


def _to_docs(source: DataFrame, by_doc: DataFrame, how: str, column: str) -> DataFrame:
    by_doc = by_doc.select(F.col("doc_id").alias("its_id"), F.col("text_key").alias("its_key"), column)
    on = F.col("doc_id").eqNullSafe(F.col("its_id")) & (F.col("text_key") == F.col("its_key"))
    return source.join(by_doc, on, how).select("doc_id", "text_key", "text", column)


#: DuckDB's version: every window as text.
ORACLE_SQL = """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(words) - 33)) AS i, words FROM w WHERE len(words) >= 35),
h AS (SELECT doc_id, i, array_to_string(list_slice(words, i, i + 34), ' ') AS win FROM s),
r AS (SELECT doc_id, i FROM h QUALIFY count(*) OVER (PARTITION BY win) > 1),
gone AS (SELECT doc_id, list(DISTINCT k) AS ks FROM (SELECT doc_id, unnest(range(i, i + 35)) AS k FROM r) GROUP BY doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(len(ks), 0)::BIGINT AS n_removed,
  sha256(CASE WHEN ks IS NULL THEN array_to_string(words, ' ')
    ELSE coalesce(array_to_string(list_filter(list_transform(range(1, len(words) + 1), lambda k: CASE WHEN list_contains(ks, k) THEN NULL ELSE words[k] END), lambda x: x IS NOT NULL), ' '), '') END) AS kept_sha256
FROM w LEFT JOIN gone ON gone.doc_id = w.doc_id
"""
