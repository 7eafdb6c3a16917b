"""Text functions as Column expressions, with plain-Python twins for query strings, which are scalars on the driver."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_CJK_RANGES = ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF))
CJK = "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in _CJK_RANGES)
_FULL_WIDTH = {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
_FOLDED = {"　": " ", "‘": "'", "’": "'", "“": '"', "”": '"', **_FULL_WIDTH}
_WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Capital sigma is folded first: lower-casing must not depend on where in a word it stands.
_TRANSLATED = {**_FOLDED, "Σ": "σ"}
_ANY_TRANSLATED = "[Σ\u3000\u2018\u2019\u201c\u201d\uff01-\uff5e]"


def _c(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def trim_unicode(text: Column | str) -> Column:
    return F.trim(_c(text), F.lit(_WHITE_SPACE))


def normalize_text(text: Column | str) -> Column:
    """Trimmed, full width and curly quotes folded, lower case."""
    text = _c(text)
    folded = F.translate(trim_unicode(text), "".join(_TRANSLATED), "".join(_TRANSLATED.values()))
    plain = F.lower(F.trim(text, F.lit(" \t\n\x0b\x0c\r")))
    return F.when(_is_ascii(text), plain).when(text.rlike(_ANY_TRANSLATED), F.lower(folded)).otherwise(F.lower(trim_unicode(text)))


def _is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def normalized_tag(text: Column | str) -> Column:
    """``normalize_text`` with inner white space collapsed."""
    return trim_unicode(F.regexp_replace(normalize_text(text), r"(?U)\s+", " "))


def tag_set(tags: Column | str) -> Column:
    """Normalised tags, sorted, without repeats and empty ones."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(_c(tags), normalized_tag), lambda t: t != "")))


def tokenize(text: Column | str) -> Column:
    """Words of letters, digits and underscores; a CJK run gives its characters, then its pairs."""

    def parts(run: Column) -> Column:
        chars = F.regexp_extract_all(run, F.lit("(?s)."), F.lit(0))
        pairs = F.zip_with(F.slice(chars, F.lit(1), F.size(chars) - 1), F.slice(chars, F.lit(2), F.size(chars)), lambda a, b: F.concat(a, b))
        return F.when(run.rlike(f"^[{CJK}]"), F.when(F.size(chars) > 1, F.concat(chars, pairs)).otherwise(chars)).otherwise(F.array(run))

    mixed = F.lit(rf"[{CJK}]+|[\p{{IsAlphabetic}}\p{{N}}_&&[^{CJK}]]+")
    plain, ascii_words = F.lit(r"[a-z0-9_\p{IsAlphabetic}\p{N}]+"), F.lit("[a-z0-9_]+")
    words = lambda t, pattern: F.regexp_extract_all(t, pattern, F.lit(0))
    return let(
        normalize_text(text),
        lambda t: F.when(_is_ascii(t), words(t, ascii_words)).when(t.rlike(f"[{CJK}]"), F.flatten(F.transform(words(t, mixed), parts))).otherwise(words(t, plain)),
    )


def count_tokens(text: Column | str) -> Column:
    """Estimated model tokens: 0.25 for an ASCII character, 0.48 for any other, rounded up."""
    ascii_only = F.length(F.regexp_replace(_c(text), r"[^\x00-\x7F]", ""))
    return F.floor((F.lit(48) * F.length(_c(text)) - F.lit(23) * ascii_only + 99) / 100).cast("long")


def truncate_to_tokens(text: Column | str, budget: int) -> Column:
    """The longest beginning within ``budget`` tokens."""
    text = _c(text)
    if budget <= 0:
        return F.when(text.isNotNull(), F.lit(""))
    chars = F.regexp_extract_all(F.substring(text, 1, budget * 4), F.lit("(?s)."), F.lit(0))
    state = F.struct(F.lit(0).alias("n"), F.lit(0).alias("used"), F.lit(True).alias("open"))

    def step(acc: Column, char: Column) -> Column:
        used = acc["used"] + F.when(char.rlike(r"^[\x00-\x7F]"), 25).otherwise(48)
        fits = acc["open"] & (used <= budget * 100)
        return F.struct((acc["n"] + fits.cast("int")).alias("n"), F.when(fits, used).otherwise(acc["used"]).alias("used"), fits.alias("open"))

    return F.when(count_tokens(text) <= budget, text).otherwise(text.substr(F.lit(1), F.aggregate(chars, state, step, lambda a: a["n"])))


def digest(text: Column | str) -> Column:
    return F.sha2(_c(text), 256)


#: (pattern, replacement): the passes of the Markdown cleaner, in order. Links go before images, so an image leaves "!alt".
MARKDOWN_PASSES = (
    (r"<[^>]+>", ""),
    (r"#+\s?", ""),
    (r"(?:\*\*|__)(.*?)(?:\*\*|__)", "$1"),
    (r"[*_](.*?)[*_]", "$1"),
    (r"\[(.*?)\]\(.*?\)", "$1"),
    (r"!\[.*?\]\(.*?\)", ""),
    (r"(?s)```.*?```", ""),
    (r"`([^`]+)`", "$1"),
    (r"(?m)^[-*+]\s+", ""),
    (r"(?m)^\d+\.\s+", ""),
    (r"(?m)^>\s+", ""),
    (r"---+", ""),
    (r"\|", " "),
)


#: Where this is not found, no pass of the cleaner finds anything.
MARKDOWN_SIGNS = r"(?dUm)[<#*_\[`>|]|^[-+\d]|---"


def clean_markdown(text: Column | str) -> Column:
    """Readable text without Markdown marks."""
    return let(_c(text), lambda t: F.when(t.rlike(MARKDOWN_SIGNS), _without_marks(t)).otherwise(trim_unicode(t)))


def _without_marks(out: Column) -> Column:
    for pattern, replacement in MARKDOWN_PASSES:
        out = F.regexp_replace(out, "(?dU)" + pattern, replacement)
    return trim_unicode(out)


def note_stem(path: Column | str) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(F.element_at(F.split(_c(path), "/"), -1), r"\.[^.]*$", "")


def note_dirs(path: Column | str) -> Column:
    """Directories of a path, outermost first."""
    parts = F.split(_c(path), "/")
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def relative_note_path(root: str, path: Column | str) -> Column:
    """``path`` below ``root`` with forward slashes; null where it is not strictly below."""
    path, base = F.translate(_c(path), "\\", "/"), root.replace("\\", "/").rstrip("/") + "/"
    return F.when(path.startswith(base) & (F.length(path) > len(base)), path.substr(F.lit(len(base) + 1), F.length(path)))


def attribute_text(attributes: Column | str) -> Column:
    """``k v1 v2`` for every attribute, in order of keys."""
    entries = F.array_sort(F.map_entries(_c(attributes)))
    return F.array_join(F.transform(entries, lambda e: F.concat_ws(" ", e["key"], F.array_join(e["value"], " "))), " ")


def entity_body(aliases: Column, summary: Column, attributes: Column) -> Column:
    """What of an entity is searched besides its name."""
    return F.concat_ws(" ", F.array_join(aliases, " "), F.coalesce(summary, F.lit("")), attribute_text(attributes))


def token_weight(tokens: Column, wanted: list[str]) -> Column:
    """2 for every wanted token of several characters that occurs, 1 for a single character."""
    hits = F.array_intersect(tokens, F.array(*map(F.lit, wanted)) if wanted else F.array().cast("array<string>"))
    return F.aggregate(hits, F.lit(0), lambda acc, t: acc + F.when(F.length(t) > 1, 2).otherwise(1))


# Query strings.


def is_cjk(char: str) -> bool:
    return any(a <= ord(char) <= b for a, b in _CJK_RANGES)


def normalize_query(text: str) -> str:
    return "".join(_FOLDED.get(c, c).lower() for c in text.strip(_WHITE_SPACE))


def tokenize_query(text: str) -> list[str]:
    cjk = "".join(f"{chr(a)}-{chr(b)}" for a, b in _CJK_RANGES)
    out: list[str] = []
    for run in re.findall(rf"[{cjk}]+|(?:(?![{cjk}])\w)+", normalize_query(text)):
        out += [*run, *(a + b for a, b in zip(run, run[1:]))] if is_cjk(run[0]) else [run]
    return out


def query_terms(text: str, strict: bool) -> list[str]:
    """Distinct tokens in order; only the strict pass asks for pairs of CJK characters."""
    return [t for t in dict.fromkeys(tokenize_query(text)) if strict or not (len(t) == 2 and all(map(is_cjk, t)))]


def count_query_tokens(text: str) -> int:
    return -(-sum(25 if ord(c) < 128 else 48 for c in text) // 100)


def remaining_query(query: str, names: list[str]) -> str:
    """``query`` with each name replaced by a space, one after the other, case-sensitively."""
    for name in names:
        if name:
            query = query.replace(name, " ")
    return query
