"""Line dedup: winnowing over line hashes, with DataFrame functions only.

Lines are the ``\\n``-split parts of a text, compared after trimming blanks; blank lines take no part and stay.
A run is ``run`` or more neighbouring lines. A line goes if it lies in a run of ``run`` lines that also starts earlier:
in a document with a smaller ``doc_id``, or earlier in the same one. A line of over ``long`` words is a run of its own
(``long`` None: no line is).

1. Each window of ``run`` line hashes gives its least hash (the leftmost of equals) as fingerprint. Equal runs have equal
   fingerprints at equal offsets, so fingerprints seen once are dropped: nothing that repeats is lost.
2. Positions with a fingerprint seen before are joined to the repeated fingerprints and extended both ways, to all the
   windows of ``run`` lines around them; windows are matched by the hash of all their lines. Chained windows make up runs of
   any length.
3. Each window's first place is an aggregate (combined before the shuffle, so a line that a third of all documents
   share costs a row a task); windows elsewhere are deleted. No pairs of documents are made.
4. Long lines are matched by the same hashes and by the same aggregate, each as a window of one line.

Nulls and empty texts have no lines. Repeated rows: see ``common``. Texts of under ``run`` lines lose long lines only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spreadrank.llm.common import bound, materialize, one_row_per_doc, words

BLANK = " \t\r\x0b\x0c"


def _lines(df: DataFrame) -> DataFrame:
    """doc_id and ``at``: (index, hash) of each line that isn't blank."""
    parts = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(i.alias("i"), F.btrim(x, F.lit(BLANK)).alias("t")))
    kept = F.filter(parts, lambda s: s["t"] != "")
    return df.filter(F.col("text").isNotNull()).select("doc_id", F.transform(kept, lambda s: s["t"]).alias("t"))


def repeated_windows(docs: DataFrame, run: int = 2) -> DataFrame:
    """(doc_id, start): windows of ``run`` lines, counted without blank lines, that also start earlier."""
    if run < 1:
        raise ValueError("run must be 1 or more")
    hashed = _lines(docs).select("doc_id", F.transform("t", lambda x: F.xxhash64(x)).alias("h")).filter(F.size("h") >= run)

    def least(h):
        starts = F.sequence(F.lit(0), F.size(h) - run)
        at = F.transform(starts, lambda s: bound(F.slice(h, s + 1, run), lambda w: s + F.array_position(w, F.array_min(w)).cast("int") - 1))
        return F.transform(
            F.array_distinct(at),
            lambda p: F.struct(
                F.get(h, p).alias("f"),
                F.greatest(p - run + 1, F.lit(0)).alias("first"),
                F.slice(h, F.greatest(p - run + 2, F.lit(1)), F.least(p + run, F.size(h)) - F.greatest(p - run + 1, F.lit(0))).alias("around"),
            ),
        )

    marks = hashed.select("doc_id", F.explode(bound(F.col("h"), least)).alias("m")).select("doc_id", "m.*")
    seen = marks.groupBy("f").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("f")
    joined = marks.join(seen, "f")
    windows = joined.select("doc_id", F.explode(F.transform(F.sequence(F.lit(0), F.size("around") - run), lambda o: F.struct((F.col("first") + o).alias("start"), F.xxhash64(F.slice("around", o + 1, run)).alias("key")))).alias("w")).select("doc_id", "w.*")
    return _later(materialize(windows, "line-windows"))


def repeated_long_lines(docs: DataFrame, long: int) -> DataFrame:
    """(doc_id, start): lines of over ``long`` words, counted without blank lines, that are also in an earlier place."""
    marked = F.transform("t", lambda x, i: F.when((F.length(x) > 2 * long) & (F.size(words(x)) > long), F.struct(i.alias("start"), F.xxhash64(x).alias("key"))))
    lines = _lines(docs).select("doc_id", F.explode(F.filter(marked, lambda s: s.isNotNull())).alias("w")).select("doc_id", "w.*")
    return _later(materialize(lines, "long-lines"))


def _later(windows: DataFrame) -> DataFrame:
    """(doc_id, start) of the rows (doc_id, start, key) whose key has an earlier place."""
    first = windows.groupBy("key").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", "first")
    return windows.join(first, "key").filter(F.struct("doc_id", "start") > F.col("first")).select("doc_id", "start")


def dedup_lines(docs: DataFrame, run: int = 2, long: int | None = 50) -> DataFrame:
    """``docs`` with repeated lines cut from ``text``, ``n_chars`` (if there) set anew; adds n_lines, n_removed, n_runs.

    A document stays even if all its lines go; its text is then empty.
    """
    docs = one_row_per_doc(docs)
    spans = repeated_windows(docs.select("doc_id", "text"), run).withColumn("n", F.lit(run))
    if long is not None:
        spans = spans.unionByName(repeated_long_lines(docs.select("doc_id", "text"), long).withColumn("n", F.lit(1)))
    lines = F.flatten(F.collect_list(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)))
    gone = spans.groupBy("doc_id").agg(F.sort_array(F.array_distinct(lines)).alias("__lines"))
    df = docs.join(gone, "doc_id", "left")
    parts = F.split("text", "\n", -1)
    full = F.filter(F.transform(parts, lambda x, i: F.when(F.btrim(x, F.lit(BLANK)) != "", i)), lambda i: i.isNotNull())

    df = df.withColumn("__gone", F.when(F.col("__lines").isNotNull(), bound(full, lambda at: F.transform("__lines", lambda o: F.get(at, o)))))

    def rest(lines):
        keep = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__gone"))
        return F.array_join(F.transform(keep, lambda i: F.get(lines, i)), "\n")

    at = F.col("__lines")
    runs = F.size(F.filter(F.transform(at, lambda o, i: (i == 0) | (o > F.get(at, i - 1) + 1)), lambda x: x))
    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(bound(parts, rest))
    out = df.withColumns({"__n": F.when(F.col("text").isNull(), 0).otherwise(F.size(parts)).cast("long"), "__m": F.coalesce(F.size("__gone"), F.lit(0)).cast("long"), "__k": F.when(at.isNull(), 0).otherwise(runs).cast("long"), "__text": text})
    columns = [F.col("__text").alias("text") if c == "text" else F.length("__text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns if c not in ("n_lines", "n_removed", "n_runs")]
    return out.select(*columns, F.col("__n").alias("n_lines"), F.col("__m").alias("n_removed"), F.col("__k").alias("n_runs"))
