"""Page-level filters, section skipping and captions of extracted documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import cleaning, probes

#: Labels of items that are no narrative (fixed values).
NOT_NARRATIVE = ("caption", "picture", "table", "footnote")


def is_caption(label: Column, text: Column) -> Column:
    """Whether an item is a caption or no narrative, by its label or its wording."""
    return F.coalesce(F.lower(label).isin(*NOT_NARRATIVE), F.lit(False)) | F.coalesce(T.strip(text).rlike(cleaning.CAPTION), F.lit(False))


def page_verdict(text: Column, is_pdf: Column, titles: bool = True, index: bool = True, bibliography: bool = True, contents: bool = True) -> Column:
    """Why a page goes: title, index, bibliography or contents, tested in this order; null if it stays."""
    front = is_pdf & cleaning.is_front_matter(text)
    book, dense = is_pdf & cleaning.is_book_list(text), F.coalesce(cleaning.is_index_page(text), F.lit(False)) & F.lit(index)
    as_index = dense | F.lower(text).contains("index")
    none = F.lit(None).cast("string")
    out = F.when(front, "title") if titles else F.when(F.lit(False), none)
    if index:
        out = out.when((book | dense) & as_index, "index")
    if bibliography:
        out = out.when((book | dense) & ~as_index, "bibliography")
    return out.when(F.coalesce(cleaning.is_contents_page(text), F.lit(False)), "contents") if contents else out


def kept_items(items: DataFrame, doc: str = "doc_id", page: str = "page", seq: str = "seq", **switches) -> DataFrame:
    """items (doc, page, seq, label, text) on pages that stay, without running headers and captions.

    A page is judged by its items' texts in order. Headers are lines that stand on many pages of a document.
    """
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(seq).alias("s"), F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"]), "\n")
    pages = items.groupBy(doc, page).agg(text.alias("text"))
    gone = pages.where(page_verdict(F.col("text"), F.lit(True), **switches).isNotNull()).select(doc, page)
    headers = probes.page_furniture(pages, doc, page).select(doc, F.col("line").alias("__line"))
    left = items.where(~is_caption(F.col("label"), F.col("text"))).withColumn("__line", T.strip(F.coalesce("text", F.lit(""))))
    return left.join(gone, [doc, page], "left_anti").join(headers, [doc, "__line"], "left_anti").select(*items.columns)


def outside_sections(items: DataFrame, excluded: str, levels: int = 6, doc: str = "doc_id", seq: str = "seq") -> DataFrame:
    """items (doc, seq, level, text; level null but for headers) outside excluded sections, by windows alone.

    A section goes from a header that matches until the next one of the same or a higher rank. For each rank k the open
    header of an item is the last of rank up to k before it, at or above that of rank k itself; an item goes if any of its
    open headers matches, since a header inside a skipped section opens nothing of a higher rank.
    """
    w = W.partitionBy(doc).orderBy(seq).rowsBetween(W.unboundedPreceding, 0)
    match = F.col("level").isNotNull() & F.coalesce(F.col("text"), F.lit("")).rlike(f"(?i){excluded}")
    d = items.withColumn("__match", match)
    inside = F.lit(False)
    for k in range(1, levels + 1):
        # The last header of rank up to k: it is still open, and excluded if it matches and is of rank k itself.
        last = F.last(F.when(F.col("level") <= k, F.struct(F.col("level").alias("l"), F.col("__match").alias("m"))), ignorenulls=True).over(w)
        inside = inside | F.coalesce((last["l"] == k) & last["m"], F.lit(False))
    return d.withColumn("__inside", inside).where("not __inside").drop("__match", "__inside")
