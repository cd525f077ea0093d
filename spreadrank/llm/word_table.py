"""Work done once for each different word of a corpus, and brought back to the documents that have it.

A word table grows with the corpus, so it is never broadcast whole. Its most frequent words, HOT at most by the count they
must reach, are sent to every task; that takes the hot keys and most occurrences out of the shuffle. The others are
joined on the word. Both parts are combined for each document before they are shuffled by document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The most words that are sent to every task.
HOT = 200_000


def hot_count(table: DataFrame, n: str = "n", hot: int = HOT) -> int:
    """The least power of two that at most ``hot`` words of the table reach with their count."""
    sizes = table.groupBy(F.floor(F.log2(n)).cast("int").alias("e")).agg(F.count(F.lit(1)).alias("k"))
    total, least = 0, 62
    for e, k in sorted(((r["e"], r["k"]) for r in sizes.collect()), reverse=True):  # 64 rows at most
        total += k
        if total > hot:
            break
        least = e
    return 1 << least


def per_document(words: DataFrame, table: DataFrame, keys: list[str], aggs: Callable[[], list[Column]], n: str = "n", hot: int = HOT) -> DataFrame:
    """``aggs`` over the rows of ``words`` (doc_id, keys, ...) joined with ``table`` (keys, n, ...), for each doc_id."""
    least = hot_count(table, n, hot)
    often = F.broadcast(table.filter(F.col(n) >= least))
    seldom = table.filter(F.col(n) < least)
    rest = words.join(F.broadcast(table.filter(F.col(n) >= least).select(*keys)), keys, "left_anti")
    values = [c for c in table.columns if c != n]
    columns = ["doc_id", *[c for c in words.columns if c != "doc_id"], *[c for c in values if c not in keys]]
    both = words.join(often, keys).select(*columns).unionByName(rest.join(seldom, keys).select(*columns))
    return both.groupBy("doc_id").agg(*aggs())
