"""Quality rules: rule counts of each text and cross-document line frequency, with DataFrame functions only.

Lines are normalised (trimmed, runs of blanks made one, A-Z lower-cased) and hashed; for each host the documents that
have a line are counted (a document counts once). A line is removed from a host's documents if more of them have it than
``max(line_docs, line_share * documents of the host)``. A document is depleted if what stays has less than
``min_left`` of its words; base rules and depletion give ``kept``.

Null texts have no words (they fail the base rule of ``min_words``); a null host is a host of its own. Repeated rows: see
``common``. The line counts are combined before the shuffle, and over-frequent lines are joined on (host, line), which Spark
can split, so a host or a line with a third of all rows does no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spreadrank.llm.common import SPACE, bound, lower_ascii, one_row_per_doc, words

SYMBOLS = "#*$%&|<>"


def repeat_words(word_array: Column, n: int = 3) -> Column:
    """Words that lie in an ``n``-word window found twice or more in the array, first finds included."""

    def of_hashes(h: Column) -> Column:
        def of_sorted(s: Column) -> Column:
            twice = F.filter(F.transform(s, lambda x, i: F.when((x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]), x["i"])), lambda i: i.isNotNull())
            return bound(F.sort_array(twice), lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(n), F.coalesce(F.get(p, i + 1) - x, F.lit(n)))), F.lit(0), lambda a, x: a + x))

        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(bound(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), of_sorted))

    def of_words(w: Column) -> Column:
        return bound(F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(n)])), of_hashes)

    return F.when(F.size(word_array) <= n, 0).otherwise(bound(word_array, of_words)).cast("long")


def rule_counts(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of every whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    full = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return docs.select(
        "doc_id",
        F.size(words(text)).cast("long").alias("n_words"),
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        bound(full, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeat_words(words(text)).alias("n_repeat_words"),
    )


def line_table(docs: DataFrame, host: str) -> DataFrame:
    """doc_id, host, line (hash), n, w: each different line of a document, how often it has it and its words."""
    lines = F.filter(F.transform(F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1), lambda x: F.btrim(F.regexp_replace(lower_ascii(x), SPACE, " "))), lambda x: x != "")
    rows = docs.select("doc_id", F.col(host).alias("host"), F.explode(lines).alias("t"))
    return rows.select("doc_id", F.coalesce("host", F.lit("\x00")).alias("host"), F.xxhash64("t").alias("line"), (F.length("t") - F.length(F.translate("t", " ", "")) + 1).alias("w"))


def frequent_lines(docs: DataFrame, host: str = "source", line_docs: int = 20, line_share: float = 0.01) -> DataFrame:
    """(host, line): lines of more documents of the host than the limit allows."""
    one = F.array_distinct(F.transform(F.filter(F.transform(F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1), lambda x: F.btrim(F.regexp_replace(lower_ascii(x), SPACE, " "))), lambda x: x != ""), lambda x: F.xxhash64(x)))
    own = F.coalesce(F.col(host), F.lit("\x00")).alias("host")
    counts = docs.select(own, F.explode(one).alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n_docs")).filter(F.col("n_docs") > line_docs)
    hosts = docs.select(own).groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"))
    return counts.join(hosts, "host").filter(F.col("n_docs") > F.col("host_docs") * F.lit(line_share)).select("host", "line")


def quality_rules(docs: DataFrame, host: str = "source", line_docs: int = 20, line_share: float = 0.01, min_left: float = 0.3, min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """rule_counts() and n_removed_lines, n_left_words, base_failed, kept, a row for each document."""
    docs = one_row_per_doc(docs, columns=["text", host])
    gone = line_table(docs, host).join(frequent_lines(docs, host, line_docs, line_share), ["host", "line"]).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_removed_lines"), F.sum("w").alias("gone_words"))
    df = rule_counts(docs).join(gone, "doc_id", "left").withColumns({"n_removed_lines": F.coalesce("n_removed_lines", F.lit(0)).cast("long"), "n_left_words": (F.col("n_words") - F.coalesce("gone_words", F.lit(0))).cast("long")})
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    df = df.drop("gone_words").withColumn("base_failed", failed)
    return df.withColumn("kept", ~F.col("base_failed") & (F.col("n_left_words") >= F.lit(min_left) * F.col("n_words")))
