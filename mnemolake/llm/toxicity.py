"""Toxicity by Levenshtein automata intersected with a trie of learnt terms.

The lexicon is learnt from labelled rows: word beginnings that stand in toxic documents far more often than elsewhere,
each the longest that still covers the same documents. Terms are held in a trie. A Levenshtein automaton (letters left out,
put in, replaced or swapped; one edit from five letters, two from nine) runs over it; their intersection is a deterministic
automaton built lazily, so a word costs a few table lookups and most words leave it after some letters. A term is matched
with edits only where such matches are rare in clean training texts. Matches in quotation, or next to reporting words, are told apart from direct use by the
words around them, and a logistic regression turns the counts into a score. Scoring sees the text alone.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from mnemolake.llm.common import LONGEST_KEPT, cut, sliced

#: Labelled rows used for fitting, those with the smallest hashes of their ids: a documented bound.
TRAINING_ROWS = 20_000
#: Letters of the shortest and longest beginnings; whole words have three letters or more, whatever their length.
SHORTEST, LONGEST = 4, 32
#: Letters from which a term may match with one edit, and with two.
ONE_EDIT, TWO_EDITS = 5, 9
#: What a match with edits counts beside an exact one.
MISSPELT = 0.8
CONTEXT = 6
#: How many times more often, by document, a term stands in toxic rows than in others.
PURITY = 20
#: Chance that any term at all qualifies where labels say nothing; with it the test is as strict as there are terms.
CHANCE = 0.01
FITTING_TASKS = 24
#: Words whose match a Python worker remembers; most words leave the automaton after some letters, so few are worth it.
CACHE_WORDS = 50_000

_WORD = re.compile(r"[^\W_]+(?:[*@$!0-9_]+[^\W_]+)*")
_REPORTING = frozenset("said says quote quoted quotes called cited reported wrote written word words term insult slur citation dit écrit mot sagte schrieb wort dijo escribió palabra".split())
_OPEN, _CLOSE = "\"“”„«»‹›", "\"“”«»‹›"


@dataclass
class Model:
    """Terms (edits allowed by term) with what they match, and the regression's weights."""

    stems: list[str]
    words: list[str]
    weights: list[float]
    quoted: float = 0.5
    edits: dict[str, int] = field(default_factory=dict)
    _matcher: Matcher | None = field(default=None, repr=False, compare=False)

    def matcher(self) -> Matcher:
        if self._matcher is None:
            self._matcher = Matcher(self.stems, self.words, self.edits)
        return self._matcher


def most_edits(term: str) -> int:
    return (len(term) >= ONE_EDIT) + (len(term) >= TWO_EDITS)


class Matcher:
    """The intersection of the lexicon's trie with Levenshtein automata.

    A state is a frozen set of (trie node, edits, letter that must follow to end a swap or ""); reading a letter follows,
    deletes, inserts, replaces or swaps. ``word`` gives the edits of the best match and its term, or None. Stems match the
    beginning of a word, words all of it. ``edits`` has the most edits by term; by default length decides.
    """

    def __init__(self, stems: list[str], words: list[str], edits: dict[str, int] | None = None) -> None:
        self.nodes: list[dict[str, int]] = [{}]
        self.stem: list[str | None] = [None]
        self.whole: list[str | None] = [None]
        self.most = [0]  # edits that any term below a node allows
        self.allowed = {t: most_edits(t) if edits is None else edits.get(t, 0) for t in (*stems, *words)}
        for term, ends in [*((t, self.stem) for t in stems), *((t, self.whole) for t in words)]:
            at = 0
            self.most[0] = max(self.most[0], self.allowed[term])
            for letter in term:
                if letter not in self.nodes[at]:
                    self.nodes[at][letter] = len(self.nodes)
                    self.nodes.append({}), self.stem.append(None), self.whole.append(None), self.most.append(0)
                at = self.nodes[at][letter]
                self.most[at] = max(self.most[at], self.allowed[term])
            ends[at] = term
        self.ids: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.ends: list[tuple[tuple[int, str] | None, tuple[int, str] | None]] = []
        self.table: list[dict[str, int]] = []
        self.start = self._id({(0, 0, "")})
        self.cache: dict[str, tuple[int, str] | None] = {}

    def _id(self, found: set[tuple[int, int, str]]) -> int:
        todo = list(found)
        while todo:  # a letter left out is an edit without reading
            node, edits, due = todo.pop()
            if not due and edits < self.most[node]:
                for child in self.nodes[node].values():
                    if edits < self.most[child] and (more := (child, edits + 1, "")) not in found:
                        found.add(more)
                        todo.append(more)
        best: dict[tuple[int, str], int] = {}
        for node, edits, due in found:
            best[node, due] = min(edits, best.get((node, due), 9))
        key = frozenset((node, edits, due) for (node, due), edits in best.items())
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(key), self.table.append({})
            ends = []
            for terms in (self.stem, self.whole):
                hits = [(edits, terms[node]) for node, edits, due in key if not due and terms[node] is not None and edits <= self.allowed[terms[node]]]
                ends.append(min(hits, default=None))
            self.ends.append(tuple(ends))
        return self.ids[key]

    def _step(self, state: int, letter: str) -> int:
        out: set[tuple[int, int, str]] = set()
        for node, edits, due in self.sets[state]:
            if due:
                if letter == due:
                    out.add((node, edits, ""))
                continue
            child = self.nodes[node].get(letter)
            if child is not None:
                out.add((child, edits, ""))
            if edits < self.most[node]:
                out.add((node, edits + 1, ""))
                for other, c in self.nodes[node].items():
                    if edits < self.most[c]:
                        out.add((c, edits + 1, ""))
                        swapped = self.nodes[c].get(letter)
                        if swapped is not None and other != letter and edits < self.most[swapped]:
                            out.add((swapped, edits + 1, other))
        found = self._id(out) if out else -1
        self.table[state][letter] = found
        return found

    def word(self, word: str) -> tuple[int, str] | None:
        try:
            return self.cache[word]
        except KeyError:
            found = self._run(word)
            if len(word) <= LONGEST_KEPT:
                if len(self.cache) >= CACHE_WORDS:
                    self.cache.clear()
                self.cache[word] = found
            return found

    def _run(self, word: str) -> tuple[int, str] | None:
        state, best, table = self.start, None, self.table
        for letter in word:
            following = table[state].get(letter)
            state = self._step(state, letter) if following is None else following
            if state < 0:
                return best
            hit = self.ends[state][0]
            if hit is not None and (best is None or hit < best):
                best = hit
                if not hit[0]:
                    return best
        hit = self.ends[state][1]
        return hit if hit is not None and (best is None or hit < best) else best


def features(text: str, matcher: Matcher) -> tuple[float, float, float, float]:
    """(direct, quoted, direct with an edit, quoted with an edit) matches of a whole text."""
    lowered = text.lower()
    kinds = {w: 1 + (hit[0] > 0) for w in set(_WORD.findall(lowered)) if (hit := matcher.word(w))}
    counts = [0.0, 0.0, 0.0, 0.0]
    if not kinds:
        return tuple(counts)
    for m in _WORD.finditer(lowered):
        if kind := kinds.get(m[0]):
            counts[2 * (kind - 1) + _quoted(lowered, m.start(), m.end())] += 1
    return tuple(counts)


def _quoted(text: str, start: int, end: int) -> int:
    """1 if the windows before and after hold a quotation around the term, or a reporting word stands near."""
    before, after = text[max(0, start - 12 * CONTEXT) : start], text[end : end + 12 * CONTEXT]
    before_words, after_words = before.split()[-CONTEXT:], after.split()[:CONTEXT]
    opened = any(c in w for w in before_words for c in _OPEN) or before[-1:] in "'‘" and before != ""
    closed = any(c in w for w in after_words for c in _CLOSE) or after[:1] in "'’" and after != ""
    reported = any(w.strip(".,;:!?()\"'“”„«»") in _REPORTING for w in before_words[-3:] + after_words[:2])
    return int(opened and closed or reported)


def _inputs(counts: np.ndarray, quoted: float) -> np.ndarray:
    """Regression inputs: any match, and the logarithm of matches; quoted and misspelt ones weigh less."""
    all_ = counts[:, 0] + quoted * counts[:, 1] + MISSPELT * (counts[:, 2] + quoted * counts[:, 3])
    return np.column_stack([np.ones(len(counts)), np.minimum(all_, 1), np.log1p(all_)])


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 50) -> tuple[np.ndarray, float]:
    """Weights and loss; a match never speaks against toxicity, so inputs of negative weight are left out."""
    used = list(range(x.shape[1]))
    while True:
        w, loss = _newton(x[:, used], y, ridge, rounds)
        wrong = [i for i, v in zip(used, w) if i and v < 0]
        if not wrong:
            out = np.zeros(x.shape[1])
            out[used] = w
            return out, loss
        used.remove(wrong[0])


def _newton(x: np.ndarray, y: np.ndarray, ridge: float, rounds: int) -> tuple[np.ndarray, float]:
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(len(w))
    penalty[0, 0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + penalty, x.T @ (p - y) + penalty @ w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    p = np.clip(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))), 1e-12, 1 - 1e-12)
    return w, float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).sum())


def _terms(text: str | None) -> set[str]:
    """Each word beginning of a text, and each whole word with a closing mark."""
    seen = set()
    for word in set(_WORD.findall((text or "").lower())):
        seen.update(word[:n] for n in range(SHORTEST, min(len(word), LONGEST) + 1))
        if len(word) >= 3:
            seen.add(word + "$")
    return seen


def _document_counts(wanted=None):
    """Documents by term, counted per partition; of the wanted terms only, where given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in sliced(batches):
            for text in batch.column(0).to_pylist():
                counts.update(_terms(text) if wanted is None else _terms(text) & wanted.value)
        terms = list(counts)
        for at in range(0, len(terms), 50_000):
            part = terms[at : at + 50_000]
            yield pa.record_batch([pa.array(part, pa.string()), pa.array([counts[t] for t in part], pa.int64())], names=["term", "n"])

    return run


def choose_terms(rows: list[tuple[str, int, int]]) -> tuple[list[str], list[str]]:
    """(stems, words): of the qualifying terms, each beginning extended as far as it keeps its documents, without those
    that a shorter chosen one covers."""
    counts = {t: n for t, n, _ in rows}
    longer: dict[str, int] = {}
    for t in counts:
        if not t.endswith("$"):
            longer[t[:-1]] = max(longer.get(t[:-1], 0), counts[t])
    closed = [t for t in counts if not t.endswith("$") and longer.get(t, 0) < 0.9 * counts[t]]
    stems: list[str] = []
    words: list[str] = []
    chosen: set[str] = set()
    for t in sorted(closed, key=lambda t: (len(t), t)):
        if any(t[:n] in chosen for n in range(SHORTEST, len(t))):
            continue
        chosen.add(t)
        if counts.get(t + "$", 0) >= 0.9 * counts[t]:
            words.append(t)
        else:
            stems.append(t)
    for t in sorted(counts):
        if t.endswith("$") and not any(t[:n] in chosen for n in range(SHORTEST, len(t))):
            words.append(t[:-1])
    return stems, sorted(set(words))


@F.pandas_udf(LongType())
def _smallest_shingle(column: pd.Series) -> pd.Series:
    def least(text: str | None) -> int:
        words = (text or "").lower().split()
        return min((xxhash.xxh3_64_intdigest(" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2))), default=0) - (1 << 63)

    return column.map(least).astype("int64")


def training_rows(docs: DataFrame, labels: DataFrame, most: int = TRAINING_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(text, toxic) of at most ``most`` labelled rows that are not held out."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).cast("long").alias("its_id")).agg(F.max(F.when(F.col(label_col) > 0, 1).otherwise(0)).alias("toxic"))
    known = known.orderBy(F.xxhash64("its_id"), "its_id").limit(most)
    # At most `most` rows of 12 bytes are broadcast.
    return docs.join(F.broadcast(known), F.col(id_col).cast("long") == F.col("its_id")).select(F.col(text_col).cast("string").alias("text"), "toxic")


def held_out(doc_id: Column) -> Column:
    """Rows kept out of learning: crc32 of the id as text, modulo 5, is 0; null ids never."""
    return doc_id.isNotNull() & (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0)


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAINING_ROWS, **names: str) -> Model:
    """Learns terms and weights from at most ``most`` labelled rows; without any, a model that scores all texts 0."""
    spark = docs.sparkSession
    rows = cut(training_rows(docs, labels, most, **names).repartition(FITTING_TASKS), "toxic-training")
    n1, n0 = rows.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first()
    if not n1 or not n0:
        return Model([], [], [0.0 if n1 else -20.0, 0.0, 0.0])

    def counted(label: int, least: int, wanted=None) -> dict[str, int]:
        terms = distinct.where(F.col("toxic") == label).select("text").mapInArrow(_document_counts(wanted), "term string, n long")
        return {r["term"]: r["n"] for r in terms.groupBy("term").agg(F.sum("n").alias("n")).where(F.col("n") >= least).collect()}

    # Copies of one text would lend its chance words weight: a text counts once among those that share a smallest shingle.
    distinct = rows.withColumn("likeness", _smallest_shingle(F.col("text"))).dropDuplicates(["likeness", "toxic"])
    # Shares and purity are of the texts that the counts are of.
    n1, n0 = distinct.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first()
    toxic = counted(1, 3)  # bounded by the training rows
    clean = counted(0, 1, spark.sparkContext.broadcast(frozenset(toxic)))
    least = 2 * math.log(max(len(toxic), 1) / CHANCE)
    stems, words = choose_terms([(t, n, m) for t, n in toxic.items() if n * n0 > PURITY * ((m := clean.get(t, 0)) + 0.5) * n1 and _surprise(n, m, n1, n0) >= least])
    model = Model(stems, words, [], edits={t: most_edits(t) for t in (*stems, *words)})
    # A term is matched with so many edits if clean texts match that way as much more seldom as terms are told by.
    found = distinct.where("toxic = 0").select("text").mapInArrow(_edited(spark.sparkContext.broadcast(model)), "term string, edits int, n long")
    for r in found.groupBy("term", "edits").agg(F.sum("n").alias("n")).orderBy(F.desc("edits")).collect():
        if toxic.get(r["term"], toxic.get(r["term"] + "$", 0)) * n0 <= PURITY * (r["n"] + 0.5) * n1:
            model.edits[r["term"]] = min(model.edits[r["term"]], r["edits"] - 1)
    model._matcher = None
    seen = rows.mapInArrow(_count(spark.sparkContext.broadcast(model)), "toxic int, a double, b double, c double, d double").collect()  # at most `most` rows of numbers
    counts, y = np.array([list(r)[1:] for r in seen]), np.array([r["toxic"] for r in seen], float)
    choices = (0.5, 0.25, 0.0, 1.0) if ((counts[:, 1] + counts[:, 3]) > 0).sum() >= 20 else (0.5,)
    model.quoted = min(choices, key=lambda q: _fit(_inputs(counts, q), y)[1])
    model.weights = _fit(_inputs(counts, model.quoted), y)[0].tolist()
    return model


def _surprise(n: int, m: int, n1: int, n0: int) -> float:
    """The likelihood ratio of a term in n of n1 toxic and m of n0 clean texts against one that labels do not matter to."""
    share, part = n1 / (n1 + n0), lambda k, e: k * math.log(k / e) if k else 0.0
    return 2 * (part(n, (n + m) * share) + part(m, (n + m) * (1 - share)))


def _edited(shared):
    """Documents by term and edits of matches that are not exact, counted per partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, counts = shared.value.matcher(), Counter()
        for batch in sliced(batches):
            for text in batch.column(0).to_pylist():
                counts.update({(hit[1], hit[0]) for w in set(_WORD.findall((text or "").lower())) if (hit := matcher.word(w)) and hit[0]})
        terms = list(counts)
        yield pa.record_batch([pa.array([t for t, _ in terms], pa.string()), pa.array([e for _, e in terms], pa.int32()), pa.array([counts[t] for t in terms], pa.int64())], names=["term", "edits", "n"])

    return run


def _count(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = shared.value.matcher()
        for batch in sliced(batches):
            found = np.array([features(t or "", matcher) for t in batch.column(0).to_pylist()]).reshape(-1, 4)
            yield pa.record_batch([batch.column(1).cast(pa.int32()), *(pa.array(found[:, k]) for k in range(4))], names=["toxic", "a", "b", "c", "d"])

    return run


def scores(texts: list[str | None], model: Model) -> np.ndarray:
    matcher = model.matcher()
    counts = np.array([features(t or "", matcher) for t in texts]).reshape(-1, 4)
    return 1 / (1 + np.exp(-np.clip(_inputs(counts, model.quoted) @ np.array(model.weights), -30, 30)))


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            p = scores(batch.column(1).to_pylist(), shared.value)
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return run


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted (1 from a score of 0.5).

    Null text counts as empty and gets the score of a text without matches. A null id is not held out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), held_out(F.col(id_col)).alias("held_out"))
    return source.mapInArrow(_score(shared), "doc_id long, held_out boolean, score double, predicted int")


def _clean(shared, at: int):
    """The rows whose text, the column at ``at``, scores under 0.5."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            yield batch.filter(pa.array(scores(batch.column(at).to_pylist(), shared.value) < 0.5))

    return run


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns unchanged, whose text scores under 0.5."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_clean(shared, docs.columns.index(text_col)), docs.schema)
