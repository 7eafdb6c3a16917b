"""Document operators against plain Python, over the edge cases of ``data``."""

import collections
import hashlib
import re
import tracemalloc
import types
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from mnemolake.llm import common, exact_dedup, license_scan, line_dedup, mixing, packing, simhash, substring_dedup, toxicity
from tests.llm import data

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return data.documents(spark).cache()


def test_empty_tables(spark):
    none, labels = data.no_documents(spark), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.fit(none, labels)
    for result in (
        exact_dedup.exact_dedup(none), mixing.mix(none), packing.pack(none), simhash.near_duplicates(none), substring_dedup.substring_dedup(none), line_dedup.line_dedup(none), license_scan.license_scan(none),
        toxicity.toxicity(none, model), toxicity.keep_clean(none, model),
    ):
        assert result.count() == 0


def test_counting_quotient_filter_round_trip_and_merge():
    rng = np.random.default_rng(0)
    parts = []
    for _ in range(3):
        fingerprints, counts = np.unique(rng.integers(0, 1 << 60, 500, dtype=np.uint64) % 777 * np.uint64(1 << 50), return_counts=True)
        parts.append((fingerprints, counts))
    for slice_bits in (0, 1):
        want = collections.Counter()
        filters = []
        for fingerprints, counts in parts:
            mine = fingerprints >> np.uint64(63) == 0 if slice_bits else np.ones(len(fingerprints), bool)
            built = exact_dedup.CountingQuotientFilter.build(fingerprints[mine], counts[mine], slice_bits)
            again = exact_dedup.CountingQuotientFilter.from_bytes(built.to_bytes())
            assert (again.decode()[0] == fingerprints[mine]).all() and (again.decode()[1] == counts[mine]).all()
            filters.append(again)
            want.update(dict(zip(fingerprints[mine].tolist(), counts[mine].tolist())))
        merged = exact_dedup.CountingQuotientFilter.merge(filters)
        assert dict(zip(merged[0].tolist(), merged[1].tolist())) == dict(want)


def test_exact_dedup(docs):
    got = exact_dedup.exact_dedup(docs).collect()
    groups = collections.defaultdict(list)
    for r in data.rows():
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "")].append(r[0])
    want = collections.Counter()
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        for i in ids:
            want[(i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest())] += 1
    assert collections.Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_mixing(docs):
    got = mixing.mix(docs, with_copies=True).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size) for r in got) == sorted((r[0] is None, r[0] or 0, len(WORD.findall(r[1] or ""))) for r in data.rows())
    sizes = collections.Counter()
    for r in data.rows():
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    order = sorted((s for s in sizes if s is not None)) + [None]
    weights = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, free, left = {}, set(order), sum(sizes.values())
    while True:  # share, stop those above three times their size, share again
        level = left / sum(weights[s] for s in free)
        above = {s for s in free if level * weights[s] >= 3 * sizes[s]}
        if not above:
            break
        for s in above:
            target[s] = 3.0 * sizes[s]
            left -= 3 * sizes[s]
        free -= above
    target |= {s: level * weights[s] for s in free}
    largest = collections.defaultdict(int)
    taken = collections.Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source]) and r.taken == r.size * r.copies and 0 <= r.copies <= 3
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    assert all(-1 <= target[s] - taken[s] <= largest[s] for s in order)
    again = sorted(map(tuple, mixing.mix(docs).collect()), key=str)
    assert again == sorted(((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in got), key=str)


@pytest.mark.parametrize("same_text", [False, True])
def test_mixing_where_all_rows_share_an_id(spark, same_text):
    rows = [(None, " ".join(["same" if same_text else f"w{i}"] * 10), f"s{i % 3}") for i in range(120)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5), with_copies=True).collect()
    taken = collections.Counter()
    for r in got:
        taken[r.source] += r.taken
    assert dict(taken) == {"s0": 200, "s1": 400, "s2": 600} and len(got) == 120


def test_packing_lays_down_what_bin_by_bin_packing_does():
    import random

    rng = random.Random(2)
    for _ in range(20):
        counts = collections.Counter(rng.randint(1, 40) for _ in range(rng.randint(1, 120)))
        left, want = counts.copy(), collections.Counter()
        while left:
            bin_, gap = [], 40
            while fits := [n for n in left if n <= gap]:  # the longest that fits
                n = max(fits)
                bin_.append(n)
                gap -= n
                left[n] -= 1
                left += collections.Counter()
            if gap and len(bin_) > 1:
                wide = gap + bin_[-1]
                pairs = [(a + b, b, a) for a in left for b in left if a <= b and a + b <= wide and (a != b or left[a] > 1)]
                if pairs and max(pairs)[0] > bin_[-1]:
                    total = max(pairs)[0]
                    a = min(p[2] for p in pairs if p[0] == total)
                    left[bin_.pop()] += 1
                    for n in (a, total - a):
                        bin_.append(n)
                        left[n] -= 1
                    left += collections.Counter()
            want[tuple(sorted(bin_, reverse=True))] += 1
        got = collections.Counter()
        for times, pattern in packing.pack_histogram(dict(counts), 40):
            got[tuple(pattern)] += times
        assert sum(n * len(p) for p, n in got.items()) == counts.total() and sum(got.values()) == sum(want.values())


def test_word_tokenizer_on_every_letter_and_mark():
    words = packing.WordTokenizer(packing.tokenizer_path())
    assert words.by_word
    letters = [chr(c) for c in range(0x21, 0x10000) if not 0xD800 <= c < 0xE000 and chr(c).isalnum() and (c < 0x3000 or c % 37 == 0)]
    texts = [f"{c}{mark}" for c in letters for mark in (".", ",", " ")] + [f"ab{c}." for c in letters]
    for text, whole in zip(texts, words.tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert words.ids(text).tolist() == whole.ids, text


def test_word_tokenizer_equals_the_tokenizer():
    from tokenizers import Tokenizer

    whole, words = Tokenizer.from_file(packing.tokenizer_path()), packing.WordTokenizer(packing.tokenizer_path(), cache_words=20)
    texts = [r[1] or "" for r in data.rows()] + ["İstanbul ΑΣ. it's 'S don't,. ,, a.b état ẞ ª² x\x1cy z\u0085q <|endoftext|>. 12.5, ﬁn ŉa \U0001f600. 中文,日本. à é,"]
    for text in texts:
        assert words.ids(text).tolist() == whole.encode(text, add_special_tokens=False).ids


def test_packing(docs):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.tokenizer_path())
    got = packing.pack(docs, with_ids=True).collect()
    bins = collections.defaultdict(list)
    for r in got:
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length and r.start == 4096 * r.piece
        bins[r.sequence_id].append((r.offset, r.length))
    for pieces in bins.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 4096
    want, have = collections.Counter(), collections.defaultdict(int)
    for r in data.rows():
        want[(r[0], len(whole.encode(r[1] or "", add_special_tokens=False).ids) + 1)] += 1
    for r in got:
        have[r.doc_id] += r.length
    totals = collections.defaultdict(int)
    for (i, n), times in want.items():
        totals[i] += n * times
    assert dict(have) == dict(totals)
    total = sum(r.length for r in got)
    assert len(bins) <= -(-total // 4096) + 1


def test_pack_histogram_uses_everything_once():
    counts = {4096: 3, 3000: 7, 1500: 5, 1000: 9, 96: 4, 50: 30, 1: 2}
    plan = packing.pack_histogram(counts)
    used = collections.Counter()
    for times, pattern in plan:
        assert sum(pattern) <= 4096 and pattern == sorted(pattern, reverse=True)
        for n in pattern:
            used[n] += times
    assert dict(used) == counts
    # 60 and then 30 greedily; the 30 gives way to 20 + 20, which fills the bin.
    assert packing.pack_histogram({60: 1, 30: 1, 20: 2}, 100)[0] == (1, [60, 20, 20])


def _fingerprint(text, k=3):
    words = [w.encode() for w in WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _components(prints, budget=3, linked=None):
    linked = linked or (lambda a, b: (a ^ b).bit_count() <= budget)
    parent = {p: p for p in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    listed = list(parent)
    for i, a in enumerate(listed):
        for b in listed[:i]:
            if linked(a, b):
                parent[find(a)] = find(b)
    return {p: find(p) for p in parent}


def test_simhash(docs):
    got = simhash.near_duplicates(docs).collect()
    prints = collections.Counter((r[0], _fingerprint(r[1])) for r in data.rows())
    assert collections.Counter((r.doc_id, int(r.fingerprint, 16)) for r in got) == prints
    roots = _components({p for _, p in prints})
    least = {}
    for i, p in prints:
        if i is not None:
            least[roots[p]] = min(least.get(roots[p], i), i)
    assert all(r.component_id == least.get(roots[int(r.fingerprint, 16)]) for r in got)


@pytest.mark.parametrize("budget", [3, 8])
def test_trie_links_and_components(spark, budget):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    keys = set(base.tolist())
    for x in base.tolist():  # chains: each link three bits on
        for _ in range(12):
            for b in rng.integers(0, 64, budget).tolist():
                x ^= 1 << b
            keys.add(x)
    dense = int(base[0])
    keys |= {dense ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(20)}
    frame = spark.createDataFrame([(k - (1 << 64) if k >> 63 else k,) for k in keys], "fp long").selectExpr("fp", "0L AS fp2").repartition(3)
    links = simhash.links(frame, budget)
    assert links.count() < len(simhash._choices(budget)[1]) * len(keys)  # stars, not all pairs
    got = {r.node % (1 << 64): r.root % (1 << 64) for r in simhash.components(links).collect()}
    want = _components(keys, budget)
    groups = lambda m: {frozenset(k for k in m if m[k] == r) for r in set(m.values())}
    assert {g for g in groups(want) if len(g) > 1} == groups(got)


def _removed(rows, window):
    seen = collections.Counter()
    for r in rows:
        words = WORD.findall(r[1] or "")
        seen.update(tuple(words[i : i + window]) for i in range(len(words) - window + 1))
    out = []
    for r in rows:
        words = WORD.findall(r[1] or "")
        gone = set()
        for i in range(len(words) - window + 1):
            if seen[tuple(words[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((r[0], len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return collections.Counter(out)


@pytest.mark.parametrize("shard", [512, 1])
def test_substring_dedup(docs, shard):
    got = substring_dedup.substring_dedup(docs, shard_segments=shard).collect()
    assert collections.Counter(map(tuple, got)) == _removed(data.rows(), 35)


def test_suffix_automaton():
    a = substring_dedup.SuffixAutomaton()
    sequences = [[1, 2, 3, 4, 1, 2, 3], [9, 2, 3, 4, 9], [5]]
    for s in sequences:
        a.add(s)
    a.finish()
    seen = collections.Counter(tuple(s[i : i + 3]) for s in sequences for i in range(len(s) - 2))
    for s in sequences:
        assert a.repeated(s, 3) == [i for i in range(len(s) - 2) if seen[tuple(s[i : i + 3])] > 1]


def test_line_dedup(docs):
    got = collections.Counter((r.doc_id, r.n_lines, r.removed_lines) for r in line_dedup.line_dedup(docs).collect())
    rows = data.rows()
    order = sorted({(r[0], r[1] or "") for r in rows}, key=lambda r: (r[0] is None, r[0] or 0))
    same_id = collections.Counter(r[0] for r in order)
    earlier, want = [], {}
    for i, text in order:
        gone = []
        for n, line in enumerate(text.split("\n")):
            words = frozenset(WORD.findall(line))
            if words and any(5 * len(words & e) >= 4 * len(words | e) for e in earlier):
                gone.append(n)
            if words:
                earlier.append(words)
        want[(i, text)] = (i, len(text.split("\n")), ",".join(map(str, gone)))
    wanted = collections.Counter(want[(r[0], r[1] or "")] for r in rows)
    # Texts that share an id are ordered by a hash; they do not share lines here but for repeats.
    assert {k: v for k, v in got.items() if same_id[k[0]] == 1} == {k: v for k, v in wanted.items() if same_id[k[0]] == 1}
    assert sum(got.values()) == len(rows)


def test_line_dedup_similar_lines(spark):
    words = [f"w{i}" for i in range(40)]
    lines = [" ".join(words), " ".join(words[:36] + ["x"]), " ".join(words[:30]), " ".join(words[4:] + ["y", "z"]), "a b c d", "a b c d e", "a b c"]
    frame = spark.createDataFrame([(1, "\n".join(lines)), (2, lines[1] + "\nnew"), (0, None)], "doc_id long, text string")
    got = {r.doc_id: (r.removed_lines, r.text) for r in line_dedup.line_dedup(frame, with_text=True).collect()}
    assert {r.doc_id: (r.removed_lines, r.text) for r in line_dedup.line_dedup(frame, with_text=True, hot_classes=1).collect()} == got  # all words hot
    # 30 of the 37 words of the second line are the third's: 0.81; it goes, though it is only 0.75 of the first.
    assert got == {0: ("", ""), 1: ("1,2,3,5", "\n".join(lines[i] for i in (0, 4, 6))), 2: ("0", "new")}


def test_license_scan(spark, docs):
    found = {(r.doc_id, r.line_no): (r.license, r.dice) for r in license_scan.license_scan(docs).collect()}
    assert found == {(35, 2): ("MIT", 1.0)}
    text = "Licensed under the Apache License, Version 2.0.\nlicensed UNDER the apache license version 2\nThis work is licensed under the GNU General Public License, version 3\n" + license_scan.TEMPLATES["ISC"][1]
    rows = {(r.line_no, r.license) for r in license_scan.license_scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()}
    assert rows == {(0, "Apache-2.0"), (1, "Apache-2.0"), (2, "GPL-3.0"), (3, "ISC")}


def test_license_scan_wrapped_notices(spark):
    import textwrap
    from pathlib import Path

    folder = Path(license_scan.__file__).parent / "licenses"
    read = lambda name, width: textwrap.fill((folder / f"{name}.txt").read_text(), width)
    around = "unrelated words before\nand more of them here\n{}\nother words after it\nand an end"
    names = ["MIT__full", "BSD-2-Clause__full", "BSD-3-Clause__full", "Apache-2.0__header", "Apache-2.0__full", "GPL-2.0__header", "GPL-3.0__header", "GPL-2.0__full", "LGPL-3.0__header", "ISC__full"]
    texts = [(i, around.format(read(name, 60)) if i % 2 else "Copyright (c) 2020 Some One\n\n" + read(name, 70)) for i, name in enumerate(names)]
    texts += [(100, "some line\n# This file is licensed under the Apache\n# License, Version 2.0.\nother"), (101, " ".join(f"w{i}" for i in range(300)) + " " + read("MIT__full", 10**6) + " the end " * 3)]
    texts += [(102, read("MIT__full", 50)[:150] + "\n" + " ".join(f"v{i}" for i in range(200))), (103, "Released under the MIT License.\nLicensed under the MIT License.")]
    found = collections.Counter((r.doc_id, r.line_no, r.license) for r in license_scan.license_scan(spark.createDataFrame(texts, "doc_id long, text string")).collect() if r.dice >= 0.8)
    notices = {(d, name) for d, _, name in found}
    assert {(i, name.split("__")[0]) for i, name in enumerate(names)} <= notices
    assert all((i, 2, name.split("__")[0]) in found for i, name in enumerate(names) if name not in ("Apache-2.0__full", "GPL-2.0__full"))
    assert {k: n for k, n in found.items() if k[0] >= 100} == {(100, 1, "Apache-2.0"): 1, (101, 0, "MIT"): 1, (103, 0, "MIT"): 1, (103, 1, "MIT"): 1, (103, -1, "MIT"): 1}


def _apart(a: str, b: str) -> int:
    """Edits between two words: letters left out, put in, replaced, and neighbours swapped."""
    rows = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            rows[i][j] = min(rows[i - 1][j] + 1, rows[i][j - 1] + 1, rows[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                rows[i][j] = min(rows[i][j], rows[i - 2][j - 2] + 1)
    return rows[-1][-1]


def test_levenshtein_matcher():
    import random

    terms, stems = ["idiot", "scum", "disgusting", "sot"], ["vequil"]
    m, rng = toxicity.Matcher(stems, terms), random.Random(3)
    words = {"idiot", "1diot", "diot", "iidot", "idoit", "idiots", "idxxt", "scam", "sot", "sit", "disgsutign", "disgust", "vequille", "vqeuilx", "x", ""}
    for term in terms + stems:
        for _ in range(150):
            w = list(term)
            for _ in range(rng.randint(0, 3)):
                at, how = rng.randrange(len(w) + 1), rng.randrange(4)
                if how == 0:
                    w.insert(at, rng.choice("abx"))
                elif at < len(w):
                    if how == 1:
                        del w[at]
                    elif how == 2:
                        w[at] = rng.choice("abx")
                    elif at + 1 < len(w):
                        w[at : at + 2] = w[at + 1], w[at]
            words.add("".join(w))
    for word in words:
        near = [(e, t) for t in terms if (e := _apart(t, word)) <= toxicity.most_edits(t)]
        near += [(e, t) for t in stems if (e := min(_apart(t, word[:n]) for n in range(len(word) + 1))) <= toxicity.most_edits(t)]
        got = m.word(word)
        assert (got is None) == (not near) and (got is None or got[0] == min(near)[0]), (word, got, near)


def test_misspelt_terms_count_for_toxicity():
    model = toxicity.Model([], ["worthless"], [-4.0, 0.0, 6.0], edits={"worthless": 2})
    none, one, two, exact = toxicity.scores(["a plain text", "you worhtless", "you worhtless wothrless", "you worthless"], model)
    assert none < one < exact and one < two
    w, _ = toxicity._fit(np.array([[1, 1, 0.2], [1, 1, 0.9], [1, 0, 0.0], [1, 0, 0]]), np.array([0.0, 1, 0, 0]))
    assert (w[1:] >= 0).all()


def _task(run, batch):
    """The batches that a task gives, and the most MB of Python objects that it held meanwhile."""
    tracemalloc.start()
    try:
        return list(run(iter([batch]))), tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_a_batch_of_texts_is_scored_a_slice_at_a_time():
    model = toxicity.Model([], ["worthless"], [-4.0, 0.0, 9.0], edits={"worthless": 2})
    texts = [f"you worthless {i}" if i % 5 == 0 else "é" * 8000 for i in range(4000)]
    batch = pa.record_batch([pa.array(range(4000), pa.int64()), pa.array(texts), pa.array([False] * 4000)], names=["doc_id", "text", "held_out"])
    scored, most = _task(toxicity._score(types.SimpleNamespace(value=model)), batch)
    assert [p for b in scored for p in b.column(3).to_pylist()] == [int(i % 5 == 0) for i in range(4000)]
    assert most < 12  # 26 MB of texts
    clean, most = _task(toxicity._clean(types.SimpleNamespace(value=model), 1), batch)
    assert [i for b in clean for i in b.column(0).to_pylist()] == [i for i in range(4000) if i % 5]
    assert most < 12 and sum(b.num_rows for b in toxicity._clean(types.SimpleNamespace(value=model), 1)(iter([batch.slice(0, 0)]))) == 0


def test_words_remembered_are_few_and_short():
    matcher = toxicity.Matcher(["idiot"], [])
    for i in range(120_000):
        assert matcher.word(f"word{i}") is None
    assert matcher.word("idiot" + "x" * 5000) == (0, "idiot") and len(matcher.cache) <= 100_000
    assert max(map(len, matcher.cache)) <= 64


def test_packing_forgets_words_after_a_task(monkeypatch):
    monkeypatch.setattr(packing, "TaskContext", types.SimpleNamespace(get=lambda: types.SimpleNamespace(partitionId=lambda: 0)))
    path = packing.tokenizer_path()
    batch = pa.record_batch([pa.array(range(600), pa.int64()), pa.array([f"some words{i} " + "long" * 50 for i in range(600)])], names=["doc_id", "text"])
    known, seen = packing.WordTokenizer.of(path), set()
    for got in packing._pieces(path, 4096, 1, True)(iter([batch])):
        for i, raw in zip(got.column(0).to_pylist(), got.column(7).to_pylist()):
            assert np.frombuffer(raw, "<u4").tolist() == [*known.tokenizer.encode(batch.column(1)[i].as_py(), add_special_tokens=False).ids, 1]
            seen.add(i)
        assert max(map(len, known.young)) <= 64
    assert seen == set(range(600)) and len(known.young) + len(known.old) <= 1


def test_toxicity_with_a_hot_group_of_copies(spark):
    copies = [(i, "one and the same copied text is here", 1) for i in range(1500)]
    toxic = [(10_000 + i, f"unlike{i} words{i * 3} here{i * 5} badterm and filler{i}", 1) for i in range(12)]
    clean = [(20_000 + i, f"unlike{i} fine{i * 3} here{i * 5} nothing and filler{i}", 0) for i in range(1500)]
    frame = spark.createDataFrame(copies + toxic + clean, "doc_id long, text string, toxic int")
    model = toxicity.fit(frame.select("doc_id", "text"), frame.select("doc_id", "toxic"))
    assert any("badterm".startswith(t) for t in model.stems + model.words)


def test_toxicity(spark, docs):
    toxic = [(1000 + i, f"clean words here badterm{'abc'[i % 3]} and filler{i} number{i * 7}", "en", "s0") for i in range(60)]
    clean = [(2000 + i, f"clean words here nothing and filler{i} number{i * 7}", "en", "s0") for i in range(120)]
    frame = data.documents(spark, toxic + clean)
    labels = data.labels(spark).where("false").union(spark.createDataFrame([(i, 1, int(i < 2000)) for i, *_ in toxic + clean] + [(None, 1, 1), (1001, None, None)], "doc_id long, quality int, toxic int"))
    model = toxicity.fit(frame, labels)
    assert any("badterm".startswith(s) or s.startswith("badterm") for s in model.stems + model.words)
    got = toxicity.toxicity(frame, model).collect()
    assert len(got) == len(data.rows()) + 180
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert r.predicted == int(r.doc_id is not None and 1000 <= r.doc_id < 2000)
    kept = toxicity.keep_clean(frame, model)
    assert kept.columns == frame.columns and kept.count() == len(data.rows()) + 120
    assert toxicity._quoted('he said "idiot" to me', 9, 14) == 1 and toxicity._quoted("you idiot there", 4, 9) == 0


def test_near_duplicates_by_shingles(spark):
    import random

    rng = random.Random(4)
    vocabulary = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in ("ran", "sil", "tor")]
    rows = []
    for i in range(40):
        words = [rng.choice(vocabulary) for _ in range(150)]
        rows.append((10 * i, " ".join(words)))
        for k in range(1, 4):
            edited = words.copy()
            for at in rng.sample(range(150), k):
                edited[at] = "edited"
            rows.append((10 * i + k, " ".join(edited).upper() if k == 2 else " ".join(edited)))
    rows += [(None, rows[0][1]), (1000, None), (1001, ""), (1002, "two words"), (1003, "Two  WORDS"), (None, None), (1004, "other words")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    keys = {r.key: (r.doc_id, r.text or "") for r in frame.withColumn("key", common.document_key()).collect()}
    kept = {keys[r.key]: r.kept for r in simhash.near_by_shingles(frame).collect()}
    known = [k for k in keys.values()]
    sets = {k: set(simhash.shingle_hashes(k[1].encode(), 5).tolist()) for k in known}
    near = lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    roots = _components(set(known), linked=near)
    groups = collections.defaultdict(list)
    for k in known:
        groups[roots[k]].append(k)
    should, gone = len(known) - len(groups), sum(not v for v in kept.values())
    assert len(kept) == len(known) and 0.9 * should <= gone <= should
    assert all(sum(kept[k] for k in g) >= 1 and kept[min(g, key=lambda k: (k[0] is None, k[0] or 0))] for g in groups.values())
    assert simhash.near_by_shingles(frame.limit(0)).count() == 0


@pytest.mark.parametrize("crowd", ["equal prints", "near prints", "far prints", "frequent shingles"])
def test_near_duplicates_lose_no_link(spark, crowd, monkeypatch):
    """Texts whose fingerprints are alike but for chance, or whose similar ones are far off, against all pairs."""
    import random

    rng = random.Random(9)
    own, same, edits = {"equal prints": (120, 400, 1), "near prints": (700, 100, 8), "far prints": (22, 0, 0), "frequent shingles": (40, 0, 1)}[crowd]
    if crowd == "frequent shingles":
        monkeypatch.setattr(simhash, "NEAREST", 1)
        monkeypatch.setattr(simhash, "BLOCK", 100)
    notice = [f"notice{i}" for i in range(60)]
    rows = []
    for i in range(40):
        words = [f"w{rng.randrange(10**6)}" for _ in range(own)]
        for k in range(3):
            edited = words.copy()
            for at in rng.sample(range(own), edits):
                edited[at] = f"edited{rng.randrange(100)}"
            if crowd == "far prints" and k:
                edited += [f"more{k}{rng.randrange(10**6)}" for _ in range(2 * k)]
            front = ["a"] * same + (notice if crowd == "frequent shingles" else [])
            rows.append((10 * i + k, " ".join(front + edited)))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    keys = {r.key: r.doc_id for r in frame.withColumn("key", common.document_key()).collect()}
    sets = {i: set(simhash.shingle_hashes(t.encode(), 5).tolist()) for i, t in rows}
    near = lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    roots = _components(set(sets), linked=near)
    got = {keys[r.key]: r.kept for r in simhash.near_by_shingles(frame).collect()}
    first = {}
    for i in sorted(sets):
        first.setdefault(roots[i], i)
    assert got == {i: first[roots[i]] == i for i in sets} and len(first) < len(sets)


def test_near_duplicates_in_slices(spark, monkeypatch):
    """Chance pairs of long texts end at their parity; pairs and texts of several slices lose no link."""
    import random

    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in (6000, 6000, 7400)]
    sets += [np.concatenate([s[100:], rng.integers(0, 1 << 63, 90).astype(np.uint64)]) for s in sets] + [sets[1][:4000]]
    pairs = [(a, b) for a in range(len(sets)) for b in range(a)]
    columns = [[a for a, _ in pairs], [b for _, b in pairs], [len(sets[a]) for a, _ in pairs], [len(sets[b]) for _, b in pairs]]
    parity = [pa.array([simhash._parity(sets[p[e]]) for p in pairs], pa.binary()) for e in (0, 1)]
    batch = pa.record_batch([*[pa.array(c, pa.int64()) for c in columns], *parity], names=["a_key", "b_key", "a_n", "b_n", "a_parity", "b_parity"])
    passed = [p for out in simhash._parity_allows(simhash._Sets(0.8))([batch]) for p in zip(*[out.column(c).to_pylist() for c in (0, 1)])]
    assert passed == [(3, 0), (4, 1), (5, 2)]

    monkeypatch.setattr(simhash, "MOVED", 0)
    monkeypatch.setattr(simhash, "LEAST_MOVED", 1 << 10)
    monkeypatch.setattr(simhash, "TOLD", 1)
    cuts = []
    monkeypatch.setattr(simhash, "cut", lambda df, name: cuts.append(name) or common.cut(df, name))
    words = random.Random(5)
    rows = []
    for i in range(12):
        text = [f"w{words.randrange(10**6)}" for _ in range(100)]
        rows += [(10 * i + k, " ".join([*text[:50], *[f"new{k}"] * k, *text[50:]])) for k in range(3)]
    frame = spark.createDataFrame(rows * 2, "doc_id long, text string")
    keys = {r.key: r.doc_id for r in frame.withColumn("key", common.document_key()).collect()}
    got = {keys[r.key]: r.kept for r in simhash.near_by_shingles(frame).collect()}
    assert got == {i: i % 10 == 0 for i, _ in rows}
    assert cuts.count("near-pairs") > 3 and cuts.count("near-links") > 3 and cuts.count("near-sets") > 3


def test_line_dedup_shuffles_prefixes_in_slices(spark):
    import random

    rng = random.Random(11)
    vocabulary = [f"word{i}" for i in range(400)]
    lines = [rng.sample(vocabulary, 100) for _ in range(400)]
    lines += [line[:-3] + ["other", "words", "here"] for line in lines[:50]]
    frame = spark.createDataFrame([(i, " ".join(line)) for i, line in enumerate(lines)], "doc_id long, text string")
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway

    def stages():
        found = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteRecords() for i in range(found.size())}

    before = stages()
    got = {r.doc_id for r in line_dedup.line_dedup(frame).collect() if r.n_removed}
    assert got == set(range(400, 450))
    most = max(n for stage, n in stages().items() if stage not in before)
    assert most <= 0.6 * 21 * len(lines)  # of 21 words in a prefix


def _shuffled(spark, run):
    """What ``run`` gives, and the records shuffled by each of its stages."""
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway

    def stages():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        found = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteRecords() for i in range(found.size())}

    before = stages()
    got = run()
    return got, [n for stage, n in stages().items() if stage not in before]


def test_line_dedup_tells_chance_pairs_of_large_sets_in_the_join(spark):
    import random

    rng = random.Random(5)
    vocabulary = [f"word{i}" for i in range(1000)]
    lines = [rng.sample(vocabulary, 150) for _ in range(300)]
    lines += [line[:-4] + ["other", "words", "are", "here"] for line in lines[:20]]
    classes = spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "i long, words array<string>")
    keys = F.array_sort(F.transform("words", lambda w: F.xxhash64(w)))
    classes = classes.select("i", keys.alias("keys")).select("i", "keys", F.struct("i").alias("head"), line_dedup._parity(F.col("keys")).alias("parity"), line_dedup._lane(F.col("keys"), F.size("keys")).alias("lane"))
    s = F.shiftleft(F.lit(150).cast("long"), 32).bitwiseOR(F.col("at").cast("long"))
    rows = classes.select(F.col("i").alias("k1"), "parity", "lane", "head", F.posexplode(F.slice("keys", 1, 31)).alias("at", "key")).withColumn("s", s)
    met = {tuple(r) for r in line_dedup._Candidates(4, 5).join(rows, rows, "key").distinct().collect()}
    true = {(300 + i, i) for i in range(20)}
    assert true <= met and len(met) < 200  # of 50,000 pairs, of which one lane allows half


def test_line_dedup_counts_words_in_some_lines_and_keys_are_longs(spark):
    frame = spark.createDataFrame([(" ".join(f"w{i * 7 + k}" for k in range(100)),) for i in range(800)], "line string")
    rarity, records = _shuffled(spark, lambda: line_dedup._classes_of_rarity(frame))
    got = frame.select(line_dedup._keys(F.col("line"), rarity).alias("keys"))
    assert not got.schema["keys"].dataType.containsNull
    classes = {k >> 58 for r in got.collect() for k in r["keys"]}
    assert sum(records) < 800 * 100 / 4 and max(classes) in (6, 7, 8)  # words stand in 14 or 15 lines, some share a bucket


def test_line_dedup_does_not_depend_on_how_rare_words_are(spark, monkeypatch):
    import random

    rng = random.Random(3)
    vocabulary = [f"word{i}" for i in range(120)]
    lines = [rng.sample(vocabulary, 20) for _ in range(60)]
    lines += [line[: 20 - i % 4] + ["more", "words"][: i % 3] for i, line in enumerate(lines)]
    frame = spark.createDataFrame([(i, " ".join(line)) for i, line in enumerate(lines)], "doc_id long, text string")
    sets = [set(line) for line in lines]
    want = {i for i, a in enumerate(sets) if any(5 * len(a & b) >= 4 * len(a | b) for b in sets[:i])}
    for counted, hot in ((1, 4096), (line_dedup.COUNTED, 4096), (1 << 30, 4096), (1 << 30, 3)):
        monkeypatch.setattr(line_dedup, "COUNTED", counted)
        assert {r.doc_id for r in line_dedup.line_dedup(frame, hot_classes=hot).collect() if r.n_removed} == want


def test_line_dedup_shuffles_prefixes_once(spark):
    import random

    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")

    rng = random.Random(7)
    s = lambda at: 100 << 32 | at
    rows = [(key, i, s(at), i, None, i) for i in range(330) for at, key in enumerate(rng.sample(range(3000), 21))]
    rows = common.cut(spark.createDataFrame(rows, "key long, k1 long, s long, parity long, lane long, id long"))
    some = rows.where("key is not null and s is not null").repartition("key")
    try:
        _, records = _shuffled(spark, line_dedup._Candidates(4, 5).join(some, some, "key").collect)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert sum(records) == 330 * 21, records  # both sides of the join would be more


def test_line_dedup_lines_of_one_document_and_of_none(spark):
    words = [f"w{i}" for i in range(40)]
    # By number of line, the larger set is the later one and the earlier one; ids are shared, or there are none.
    lines = [words[:36], words, ["a", *words[10:]], [*words[12:], "b"], words[:37]]
    sets = [set(line) for line in lines]
    want = ",".join(str(i) for i, a in enumerate(sets) if any(5 * len(a & b) >= 4 * len(a | b) for b in sets[:i]))
    text = "\n".join(map(" ".join, lines))
    for i in (1, None):
        frame = spark.createDataFrame([(i, text)], "doc_id long, text string")
        for hot in (4096, 1):
            assert [(r.n_lines, r.removed_lines) for r in line_dedup.line_dedup(frame, hot_classes=hot).collect()] == [(5, want)]
