"""Document fingerprints from closed syncmers of words (DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import documents

K = 5
#: Code points of a gram, grams of a k-mer of code points, and words below which these count too.
GRAM, CODE_K, FEW_WORDS = 4, 5, 64
SKETCH = 64
#: Ids that share floor(id / BUCKET) are put in order together.
BUCKET = 1024


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once though a lambda refers to it for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _chosen(h: Column, k: int) -> Column:
    """Closed syncmers of a sequence known by its items' hashes: array<struct<pos int, hash long>>."""

    def at(i: Column, j: int) -> Column:
        return F.get(h, i + j)

    n = F.size(h)
    inner = [F.lit((1 << 63) - 1)]
    ok = lambda i: F.least(at(i, 0), at(i, k - 1)) <= F.least(*[at(i, j) for j in range(1, k - 1)], *inner)
    picked = F.filter(F.sequence(F.lit(0), n - k), ok)
    made = F.transform(picked, lambda i: F.struct(i.alias("pos"), F.xxhash64(*[at(i, j) for j in range(k)]).alias("hash")))
    short = F.array(F.struct(F.lit(0).alias("pos"), F.xxhash64(F.array_join(F.transform(h, lambda x: x.cast("string")), " ")).alias("hash")))
    return F.when(n >= k, made).when(n > 0, short).otherwise(F.slice(short, 1, 0))


def _grams(c: Column) -> Column:
    """Hashes of each GRAM code points in a row; of fewer, of all."""
    many = F.transform(F.sequence(F.lit(0), F.greatest(F.size(c) - GRAM, F.lit(0))), lambda i: F.xxhash64(*[F.get(c, i + j) for j in range(GRAM)]))
    return F.when(F.size(c) > 0, many).otherwise(F.array().cast("array<bigint>"))


def anchors(text: Column, k: int = K) -> Column:
    """Closed syncmers: array<struct<pos int, hash long>> of the chosen k-mers, in order.

    The text is a sequence of words (runs other than space and U+0009 to U+000D), each known by its XXH64. A k-mer
    is chosen if the smallest of its words' hashes is at its first or last word, which depends on the k-mer alone: a
    passage has the same anchors wherever it stands, and no k-mer in a row of k - 1 windows goes without one. Texts
    of fewer than k words have one anchor, the whole sequence; without words, none. Null counts as empty.

    Texts of fewer than FEW_WORDS words, be they short or of a script without spaces, have the syncmers of their code
    points as well (of five neighbouring four-grams, so of eight code points), their places counted from -1 down.
    """
    whole = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(whole, r"[\x20\x09-\x0D]+"), "")

    def both(w: Column) -> Column:
        points = F.filter(F.split(F.array_join(w, " "), ""), lambda c: c != "")
        fine = let(let(points, _grams), lambda h: _chosen(h, CODE_K))
        placed = F.transform(fine, lambda a: F.struct((-1 - a["pos"]).alias("pos"), F.bitwise_not(a["hash"]).alias("hash")))
        own = let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: _chosen(h, k))
        return F.when(F.size(w) < FEW_WORDS, F.concat(own, placed)).otherwise(own)

    return let(words, both)


def aligned(a: Column, b: Column) -> Column:
    """How many anchors two texts share at the same places. Place and hash are met as one number, as arrays of structs would be compared
    pair by pair."""
    one = lambda found: F.transform(found, lambda x: F.xxhash64(x["pos"], x["hash"]))
    return F.size(F.array_intersect(one(a), one(b))).cast("long")


def sketch(found: Column, size: int = SKETCH) -> Column:
    """The size smallest distinct anchor hashes, ascending: array<long>."""
    return F.slice(F.sort_array(F.array_distinct(F.transform(found, lambda a: a["hash"]))), 1, size)


def likeness(a: Column, b: Column, size: int = SKETCH) -> Column:
    """The Jaccard index of two texts' anchor sets as their sketches tell it; exact when both have up to size anchors.

    1 for equal sketches (two empty ones too), 0 when just one is empty.
    """
    low = F.slice(F.sort_array(F.array_union(a, b)), 1, size)
    shared = F.size(F.array_intersect(low, F.array_intersect(a, b)))
    return F.when(a == b, F.lit(1.0)).otherwise(shared / F.greatest(F.size(low), F.lit(1)))


def as_string(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def with_next(rows: DataFrame, carried: list[str], id_col: str = "doc_id") -> DataFrame:
    """rows with next_<c> for each carried column: that of the row that follows by id; the first follows the last.

    Rows are dealt once by floor(id / 1024) and put in order there, so a window holds few rows. The last row of a
    bucket gets its next from the first of the bucket that follows: a join of one row a bucket on either side, for
    which only the buckets' numbers are put in order in one place. Null ids come first; rows of one id are in the
    order of the carried columns.
    """
    bucket = F.coalesce(F.floor(F.col(id_col) / BUCKET).cast("long"), F.lit(-(1 << 62)))
    order = W.orderBy("bucket")
    known = rows.select(bucket.alias("bucket")).distinct()
    low = F.min("bucket").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    after = known.select("bucket", F.coalesce(F.lead("bucket").over(order), low).alias("after"))
    dealt = rows.select(id_col, *carried, bucket.alias("bucket")).repartition("bucket")
    turn = W.partitionBy("bucket").orderBy(F.col(id_col).asc_nulls_first(), *carried)
    placed = dealt.select("*", F.row_number().over(turn).alias("turn"), *[F.lead(c).over(turn).alias(f"next_{c}") for c in carried], F.lead(F.lit(1)).over(turn).alias("more"))
    names = [id_col, *carried, *[f"next_{c}" for c in carried]]
    inner = placed.where("more is not null").select(names)
    lasts = placed.where("more is null").select(id_col, *carried, "bucket").join(after, "bucket")
    firsts = placed.where("turn = 1").select(F.col("bucket").alias("after"), *[F.col(c).alias(f"next_{c}") for c in carried])
    return inner.union(lasts.join(firsts, "after").select(names))


def with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, next_text, edited): edited has its second half replaced by the start of the next text.

    Texts alone are shuffled, once: expressions with lambdas before the shuffle would keep its readers from sharing
    it, so sketches are left for later. Null text: empty. One row: it is its own next.
    """
    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    met = with_next(rows, ["text"], id_col)
    half = F.floor(F.char_length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.char_length("text") - half), F.substring(F.col("next_text"), F.lit(1), half))
    return met.select(id_col, "text", "next_text", edited.alias("edited"))


def op4_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """aligned_edited: anchors that the text and the edited text share at the same places."""
    made = with_edits(documents(spark, sf_dir).select("doc_id", "text"))
    made = made.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), *[anchors(F.col(c)).alias(n) for c, n in (("text", "a"), ("edited", "b"), ("next_text", "c"))])
    made = made.select("doc_id", "n_chars", "edited_sha256", aligned(F.col("a"), F.col("b")).alias("aligned_edited"), *[sketch(F.col(c)).alias(n) for c, n in (("a", "own"), ("b", "other"), ("c", "following"))])
    return made.select("doc_id", "n_chars", "edited_sha256", as_string(F.col("own")).alias("fingerprint"), as_string(F.col("other")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("other")).alias("near_edited"), likeness(F.col("own"), F.col("following")).alias("near_next"), "aligned_edited")
