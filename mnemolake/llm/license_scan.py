"""Licence scan: Dice coefficient over word bigrams against licence templates, with DataFrame functions only.

Each line, and each whole text, is lower-cased and reduced to its words. A template with m distinct word
bigrams and a unit with n can reach a coefficient t only if m t / (2 - t) <= n <= m (2 - t) / t. Units outside every
template's bounds are dropped, and each remaining one meets only the templates whose bounds it is in. Templates are a short fixed list; texts are never shuffled.

Notices wrapped over lines or standing inside a text are found as runs of words, also against the full texts and standard
headers in ``licenses``. A run that reaches t holds at least m t / (2 - t) of a template's bigrams: texts without so many
are dropped in the scan. For the rest, every run that begins and ends with a bigram of the template is scored, with
distinct bigrams counted by their last place before; other runs cannot be better.
"""

from __future__ import annotations

import math
import re
from functools import reduce
from pathlib import Path

import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemolake.llm.common import cut

THRESHOLD = 0.8
#: Templates with fewer bigrams are single sentences; as runs they only count where wrapped over lines.
NOTICE_FROM = 20
#: Slots of the table of template bigrams by hash that the scan looks into.
SLOTS = 1 << 16
_WORD = "[a-z0-9]+"

TEMPLATES: dict[str, list[str]] = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    ],
    "BSD-2-Clause": ["Released under the BSD 2-Clause License.", "Licensed under the BSD 2-Clause License."],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License.", "Licensed under the BSD 3-Clause License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3."],
    "ISC": ["Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "Proprietary": ["All rights reserved."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}


def bigrams(text: str) -> list[str]:
    """Distinct word bigrams."""
    words = re.findall(_WORD, text.lower())
    return sorted({f"{x} {y}" for x, y in zip(words, words[1:])})


def bounds(size: int, threshold: float) -> tuple[int, int]:
    """Fewest and most bigrams of a text that can reach the threshold against ``size``."""
    return math.ceil(size * threshold / (2 - threshold) - 1e-9), math.floor(size * (2 - threshold) / threshold + 1e-9)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _bigrams(words: Column) -> Column:
    return F.array_distinct(F.zip_with(F.slice(words, F.lit(1), F.size(words) - 1), F.slice(words, F.lit(2), F.size(words)), lambda x, y: F.concat(x, F.lit(" "), y)))


def notices() -> dict[str, list[str]]:
    """Full texts and standard headers by licence: files named licence__kind.txt."""
    out: dict[str, list[str]] = {}
    for file in sorted((Path(__file__).parent / "licenses").glob("*.txt")):
        out.setdefault(file.name.split("__")[0], []).append(file.read_text())
    return out


def license_scan(docs: DataFrame, threshold: float = THRESHOLD, templates: dict[str, list[str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, line_no, license, dice: for every line (from 0), and every text of several lines as a whole (line_no -1),
    the template it resembles most among those with a coefficient of ``threshold`` or more; ties go to the first name.

    Also, under the line they begin in, runs of words that resemble a notice (or a sentence wrapped over lines) so much,
    without those that share words with a better one, and those that are found as a line or whole text already.

    Nothing for null or empty texts. Repeated rows are each reported.
    """
    listed = sorted((templates or TEMPLATES).items())
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = _units(rows, listed, threshold)
    runs = _runs(rows, listed if templates else listed + sorted(notices().items()), listed, threshold)
    return found if runs is None else found.union(runs)


def _units(rows: DataFrame, listed: list[tuple[str, list[str]]], threshold: float, *more: str) -> DataFrame:
    """The best template of each line and whole text."""
    known = [(name, bigrams(text)) for name, texts in listed for text in texts]
    known = [(name, grams, *bounds(len(grams), threshold)) for name, grams in known if grams]
    lowest, highest = max(1, min(k[2] for k in known)), max(k[3] for k in known)
    text = F.col("text")
    lines = F.split(text, "\n")
    units = F.when(F.size(lines) > 1, F.concat(F.array(F.struct(F.lit(-1).alias("line_no"), text.alias("unit"))), _numbered(lines))).otherwise(_numbered(lines))
    rows = rows.select("doc_id", *more, F.inline(units))

    def resemblance(grams: Column) -> Column:
        size = F.size(grams)
        return F.array(*[
            F.when(size.between(low, high), F.struct(
                (F.lit(2.0) * F.size(F.array_intersect(grams, F.lit(mine))) / (size + len(mine))).alias("dice"), F.lit(-i).alias("rank"), F.lit(name).alias("license"),
            ))
            for i, (name, mine, low, high) in enumerate(known)
        ])

    # Bigrams without repeats are at most one fewer than words, so too few words rule a unit out, and a bounded number of
    # distinct bigrams is checked template by template.
    lowered = F.lower("unit")
    words = F.regexp_extract_all(lowered, F.lit(_WORD), F.lit(0))
    best = _let(words, lambda w: F.when(F.size(w) > lowest, _let(_bigrams(w), lambda g: F.when(F.size(g) <= highest, F.array_max(F.filter(resemblance(g), lambda x: x["dice"] >= threshold))))))
    found = _let(best, lambda b: F.when(b.isNull(), F.array().cast("array<struct<dice:double,rank:int,license:string>>")).otherwise(F.array(b)))
    return rows.select("doc_id", *more, "line_no", F.inline(found)).select("doc_id", *more, "line_no", "license", "dice")


def _hashes(words: Column) -> Column:
    most = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, F.lit(1), most), F.slice(words, F.lit(2), most), lambda x, y: F.xxhash64(x, y))


def _pairs(words: Column) -> Column:
    """Bigrams of (line, word) in order, hashed, with the lines of both words."""
    most = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, F.lit(1), most), F.slice(words, F.lit(2), most), lambda x, y: F.struct(x["line"].alias("l0"), y["line"].alias("l1"), F.xxhash64(x["word"], y["word"]).alias("g")))


def _apart(runs: Column) -> Column:
    """Of runs, best first, those that share no bigram with a better one that stays."""
    none = F.filter(runs, lambda x: F.lit(False))
    return F.aggregate(runs, none, lambda kept, x: F.when(F.exists(kept, lambda y: (y["s"] <= x["e"]) & (x["s"] <= y["e"])), kept).otherwise(F.concat(kept, F.array(x))))


def _runs(rows: DataFrame, listed: list[tuple[str, list[str]]], as_units: list[tuple[str, list[str]]], threshold: float) -> DataFrame | None:
    """doc_id, line_no, license, dice of runs of words; None if no text holds enough of any template."""
    known = [(name, grams, len(grams), *bounds(len(grams), threshold)) for name, grams in ((n, bigrams(t)) for n, ts in listed for t in ts) if grams]
    masks, lines = [0] * SLOTS, []
    for i, (name, grams, *numbers) in enumerate(known):
        for x, y in map(str.split, grams):
            g = xxhash.xxh64_intdigest(y, xxhash.xxh64_intdigest(x, 42))  # as Spark's xxhash64(x, y)
            masks[g % SLOTS] |= 1 << i % 63
            lines.append("\t".join(map(str, (i, g - (g >> 63 << 64), name, *numbers))))
    field = F.split("line", "\t")
    types = {"i": "int", "g": "long", "license": "string", "m": "int", "low": "int", "high": "int"}
    grams = rows.sparkSession.range(1).select(F.explode(F.split(F.lit("\n".join(lines)), "\n")).alias("line")).select(*[field[n].cast(t).alias(c) for n, (c, t) in enumerate(types.items())])
    words = F.regexp_extract_all(F.lower("text"), F.lit(_WORD), F.lit(0))
    table = F.split(F.lit(",".join(map(str, masks))), ",").cast("array<long>")  # folded to a literal

    # The scan: bigrams of the text in a slot that a template has, then how many each may have; the join below is exact.
    mask = lambda h: F.get(table, F.pmod(h, F.lit(SLOTS)).cast("int"))
    some = lambda w: F.array_distinct(F.filter(F.transform(_hashes(w), lambda h: F.struct(h.alias("h"), mask(h).alias("of"))), lambda x: x["of"] != 0))
    enough = lambda found: reduce(lambda a, b: a | b, [(F.size(found) >= k[3]) & (F.size(F.filter(found, lambda x: x["of"].bitwiseAND(F.lit(1 << i % 63)) != 0)) >= k[3]) for i, k in enumerate(known)])
    held = rows.select(F.monotonically_increasing_id().alias("key"), "doc_id", "text")
    held = held.where(_let(words, lambda w: _let(some(w), enough)))
    held = cut(held.select("key", "doc_id", "text"), "license-candidates")
    if held.isEmpty():
        return None
    lines = F.transform(F.split("text", "\n"), lambda line, n: F.transform(F.regexp_extract_all(F.lower(line), F.lit(_WORD), F.lit(0)), lambda w: F.struct(n.alias("line"), w.alias("word"))))
    placed = held.select("key", F.posexplode(_let(F.flatten(lines), _pairs)).alias("p", "pair")).select("key", "p", "pair.*")
    placed = placed.withColumn("last", F.coalesce(F.lag("p").over(Window.partitionBy("key", "g").orderBy("p")), F.lit(-1)))
    reported = cut(_units(held, as_units, threshold, "key"), "license-units")
    single = reported.where("line_no >= 0").select("key", F.col("line_no").alias("line"))
    hits = placed.join(F.broadcast(grams), "g")
    # A sentence that is reported as a line is not looked for across lines.
    short = hits.where(F.col("m") < NOTICE_FROM)
    for end in ("l0", "l1"):
        short = short.join(single.distinct().select(F.col("key"), F.col("line").alias(end)), ["key", end], "left_anti").select(*hits.columns)
    hits = hits.where(F.col("m") >= NOTICE_FROM).union(short)
    enough = hits.groupBy("key", "i").agg(F.countDistinct("g").alias("n"), F.first("low").alias("low")).where("n >= low").select("key", "i")
    hits = cut(hits.join(enough, ["key", "i"], "left_semi").select("key", "i", "p", "l0", "l1", "g", "license", "m", "low", "high"), "license-hits")
    if hits.isEmpty():
        return None

    before = F.lag("p").over(Window.partitionBy("key", "i").orderBy("p"))
    starts = hits.withColumn("before", before).where("before IS NULL OR before < p - 1").select("key", "i", F.col("p").alias("s"), F.col("l0").alias("line_no"), "license", "m", "low", "high")
    scored = starts.join(placed, "key").where("p >= s AND last < s")  # each distinct bigram once
    scored = scored.join(hits.select("key", "i", "p", F.lit(1).alias("hit")), ["key", "i", "p"], "left")
    growing = Window.partitionBy("key", "i", "s").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    scored = scored.withColumn("n", F.count(F.lit(1)).over(growing)).withColumn("c", F.count("hit").over(growing))
    scored = scored.where("hit = 1 AND n BETWEEN low AND high").where((F.col("m") >= NOTICE_FROM) | (F.col("line_no") < F.col("l1")))
    scored = scored.withColumn("dice", F.lit(2.0) * F.col("c") / (F.col("n") + F.col("m"))).where(F.col("dice") >= threshold)
    run = F.struct((-F.col("dice")).alias("less"), "s", F.col("p").alias("e"), "c", "line_no", F.col("l1").alias("line_end"), "license")
    best = scored.groupBy("key", "i", "s").agg(F.min(run).alias("run"))
    best = best.groupBy("key", "i").agg(_apart(F.array_sort(F.collect_list("run"))).alias("runs")).select("key", F.explode("runs").alias("r"))
    # Between templates, the one with most bigrams in common.
    best = best.select("key", F.struct((-F.col("r.c")).alias("fewer"), "r.less", "r.license", "r.s", "r.e", "r.line_no", "r.line_end").alias("run"))
    best = best.groupBy("key").agg(_apart(F.array_sort(F.collect_list("run"))).alias("runs")).select("key", F.inline("runs"))
    known_lines = single.select("key", F.col("line").alias("line_no"), F.col("line").alias("line_end")).distinct()
    best = best.join(known_lines, ["key", "line_no", "line_end"], "left_anti")
    best = best.join(reported.where("line_no = -1").select("key", "license"), ["key", "license"], "left_anti")
    return best.join(held.select("key", "doc_id"), "key").select("doc_id", "line_no", "license", (-F.col("less")).alias("dice"))


def _numbered(lines: Column) -> Column:
    return F.transform(lines, lambda line, i: F.struct(i.alias("line_no"), line.alias("unit")))


def oracle_sql(threshold: float = THRESHOLD) -> str:
    """DuckDB's version, every unit against every template."""
    known = [(i, name, text.replace("'", "''")) for i, (name, text) in enumerate((n, t) for n, ts in sorted(TEMPLATES.items()) for t in ts)]
    values = ", ".join(f"({i}, '{name}', '{text}')" for i, name, text in known)
    grams = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    return f"""
WITH tp AS (SELECT i, name, {grams} AS g FROM (SELECT col0 AS i, col1 AS name, regexp_extract_all(lower(col2), '{_WORD}') AS w FROM (VALUES {values}))),
u AS (SELECT doc_id, generate_subscripts(ls, 1) - 1 AS line_no, unnest(ls) AS unit FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
  UNION ALL SELECT doc_id, -1, text FROM documents WHERE contains(text, chr(10))),
w AS (SELECT doc_id, line_no, regexp_extract_all(lower(unit), '{_WORD}') AS w FROM u),
g AS (SELECT doc_id, line_no, {grams} AS g FROM w WHERE len(w) > 1),
d AS (SELECT doc_id, line_no, i, name, 2.0::DOUBLE * len(list_intersect(g.g, tp.g)) / (len(g.g) + len(tp.g)) AS dice
  FROM g JOIN tp ON 2.0 * least(len(g.g), len(tp.g)) >= {threshold} * (len(g.g) + len(tp.g)) - 1e-9)
SELECT doc_id, line_no::INTEGER AS line_no, name AS license, dice FROM d WHERE dice >= {threshold}
QUALIFY row_number() OVER (PARTITION BY doc_id, line_no ORDER BY dice DESC, i) = 1
"""
