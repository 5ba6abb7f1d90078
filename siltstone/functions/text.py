"""Text functions as native column expressions. Words are runs of Unicode letters, digits and underscores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Characters that the match normaliser deletes (fixed values).
MATCH_DELETED = "()[]:,;.?!`'\"#-*|"
#: Patterns and replacements of the evaluation-text normaliser, in order (fixed values).
EVAL_RULES = [
    (r"\|+", ""),
    (r"(?i)\b([a-zA-Z]+)\s+['’]\s+(s|t|d|re|ve|ll|m)\b", "$1'$2"),
    (r"\b([a-zA-Z]+)\s+['’]\s+([a-zA-Z]+)\b", "$1'$2"),
    (r"\b([a-zA-Z]{2,})\s+-\s*([a-zA-Z]{2,})\b", "$1-$2"),
    (r"\b([a-zA-Z]{2,})\s*-\s+([a-zA-Z]{2,})\b", "$1-$2"),
    (r"\s+([.,;:\?!])", "$1"),
    (r"\(\s+", "("),
    (r"\s+\)", ")"),
    (r"\be\s*\.\s*g\s*\.", "e.g."),
    (r"\bi\s*\.\s*e\s*\.", "i.e."),
    (r"“\s+", "“"),
    (r"\s+”", "”"),
    (r"  +", " "),
]


def let(value: Column, use) -> Column:
    """use(value) with value worked out once, though lambdas refer to it for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def tokens(text: Column) -> Column:
    """The default tokenizer: words and single other non-space characters."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def token_count(text: Column) -> Column:
    return F.coalesce(F.size(tokens(text)).cast("long"), F.lit(0).cast("long"))


def shingles(text: Column, n: int = 5) -> Column:
    """Distinct word n-grams; fewer than n words give one shingle, none give an empty array."""

    def cut(w: Column) -> Column:
        many = F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.array_distinct(F.when(F.size(w) >= n, many).when(F.size(w) > 0, F.array(F.array_join(w, " "))).otherwise(F.array().cast("array<string>")))

    return let(words(text), cut)


def shingle_hex(shingle: Column) -> Column:
    """The first 8 bytes of the MD5 digest, the last of them first, as 16 hexadecimal digits."""
    return F.array_join(F.reverse(F.regexp_extract_all(F.substring(F.md5(shingle), 1, 16), F.lit(".."), F.lit(0))), "")


def shingle_hash(shingle: Column) -> Column:
    """The first 8 bytes of the MD5 digest as a little-endian unsigned number, in decimal digits."""
    return F.conv(shingle_hex(shingle), 16, 10)


def match_normal(text: Column) -> Column:
    return F.lower(strip(F.translate(text, MATCH_DELETED, "")))


def answer_normal(text: Column) -> Column:
    return strip(F.regexp_replace(F.translate(F.lower(strip(F.coalesce(text, F.lit("")))), PUNCTUATION, ""), r"\s+", " "))


def eval_normal(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for pattern, to in EVAL_RULES:
        out = F.regexp_replace(out, pattern, to)
    return strip(out)


def trigrams(text: Column) -> Column:
    """Distinct character trigrams of the lower-cased text without signs."""
    clean = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\s]", "")

    def cut(c: Column) -> Column:
        made = F.transform(F.sequence(F.lit(1), F.char_length(c) - 2), lambda i: F.substring(c, i, F.lit(3)))
        return F.array_distinct(F.when(F.char_length(c) >= 3, made).otherwise(F.array().cast("array<string>")))

    return let(clean, cut)


def jaccard(a: Column, b: Column) -> Column:
    """0 if either set is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"[.?!]+"), strip), lambda s: s != "")


def bag_overlap(a: Column, b: Column) -> Column:
    """Tokens that two arrays share, repeats counted."""
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda n, t: n + F.least(F.size(F.filter(a, lambda x: x == t)), F.size(F.filter(b, lambda x: x == t))))


def token_f1(a: Column, b: Column, both_empty: float = 0.0) -> Column:
    """Bag-overlap F1; with an empty side 0, or ``both_empty`` if both are (0 for lexical, 1 for answer F1)."""
    return let(F.struct(a.alias("a"), b.alias("b")), lambda ab: _token_f1(ab["a"], ab["b"], both_empty))


def _token_f1(a: Column, b: Column, both_empty: float) -> Column:
    shared = bag_overlap(a, b)
    none = (F.size(a) == 0) | (F.size(b) == 0)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(both_empty)).when(none | (shared == 0), F.lit(0.0)).otherwise(2.0 * shared / (F.size(a) + F.size(b)))
