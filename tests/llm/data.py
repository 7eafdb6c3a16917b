"""Small tables with the cases that every operator must stand: nulls, empty and very long texts, ties, repeats, clashes."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(
    f"{name} string" for name in ("fingerprint", "salt", "rank", "row", "hash", "size", "part", "words", "text_key", "anchor", "copy", "gone", "place", "keys", "length", "g", "side")
)
CLASHES = ["clash"] * 17


def rows(more=()):
    rng = random.Random(7)
    vocabulary = [f"{a}{b}" for a in ("ba", "ko", "mi", "tu", "ze") for b in ("ran", "sil", "tor", "ven", "wix", "yol")]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    shared = text(60)
    base = [text(120) for _ in range(12)]
    out = [(i, t, "en", f"s{i % 3}") for i, t in enumerate(base)]
    out += [
        (20, base[0], "en", "s1"), (21, base[0].replace(" ", "\t\n", 3), "fr", None), (22, base[1].replace("ran", "RAN", 1), "en", "s0"),
        (23, text(10) + " " + shared, "en", "s0"), (24, shared + " " + text(10), "de", "s1"), (25, text(5) + " " + shared + " " + text(5), "en", "s2"),
        (26, "", "en", "s0"), (27, None, None, None), (None, "a null id", "en", "s1"), (None, None, None, None), (28, " \t\n ", "en", "s2"), (29, "one", "en", "s2"), (30, "é ü 中文     x", "en", "s0"),
        (31, text(20_000), "en", "s1"), (20, base[0], "en", "s1"), (32, "tie tie tie", "en", "s0"), (33, "tie tie tie", "en", "s0"), (20, "same id, another text", "en", "s1"),
        (34, "\n".join(["line one has words here", text(30), "line one has words here", "", text(30)]), "en", "s0"), (35, "line one has words here\n" + base[2] + "\nReleased under the MIT License.", "en", "s2"),
        *more,
    ]
    return out


def documents(spark, more=()):
    full = [(*r, None if r[1] is None else len(r[1]), *CLASHES) for r in rows(more)]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark):
    toxic = [(i, 1, int(i % 4 == 0)) for i in range(12)] + [(None, 1, 1), (26, None, None), (27, 0, 0), (5, 1, 1), (5, 1, 1)]
    return spark.createDataFrame(toxic, "doc_id long, quality int, toxic int")
