"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text, and perplexity against quantiles by language.

The model is one of characters: a text is its words ``[^\\x20\\x09-\\x0D]+`` with one space after each, and n-grams of ``order``
characters run over all of it, across words, from ``order - 1`` start marks on. (U+0000 and the start mark count as U+0001.)

1. Trusted documents (labelled good, not toxic) are dealt by hash: one in HELD_OUT is held out for thresholds, the others train.
2. Every n-gram of the corpus is counted, with its occurrences in training text. Continuation counts of the shorter n-grams
   are tables dealt by hash of language and n-gram; discounts D1, D2, D3+ come from their counts of counts (0.1 at
   least, so that nothing has probability 0). Joins order by order give ln p(character | context) for each n-gram of the corpus.
3. The most frequent n-grams, HOT at most, are sent to every task with their scores, and texts are scored in place. For
   texts that have other n-grams these are joined on the n-gram's hash, brought to the text, and it is scored whole.
4. A document's ln perplexity is the mean of -ln p; ``worst`` is the largest mean over ``window`` characters in a row, where a few words
   of another kind show that a long text averages away. A document is rejected if either is above the ``quantile`` of its
   language's held-out documents.

Texts without words, and languages without held-out text, have no perplexity or threshold (null) and are kept. A null
language is a language of its own. Repeated rows and null ids as in ``common``; of repeated labels, one that trusts counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spreadrank.llm.bytes_np import U, grouped, mix, pieces
from spreadrank.llm.common import drop_tables, materialize, one_row_per_doc, release
from spreadrank.llm.word_table import hot_count

START = 2
#: One trusted document in so many sets the thresholds.
HELD_OUT = 5
#: The most n-grams that are sent to every task, 16 bytes each and 8 to 16 for the places of their first bits.
HOT = 2_000_000
#: Rows up to which a table of (id) or of (language, thresholds) is sent to every task; larger ones are joined by shuffle.
SENT_ROWS = 100_000
#: Bytes of text scored at once.
RUN = 1 << 19
#: Rows of n-grams that a task holds, to sum up the runs of text it counts.
HELD = 1 << 20
#: Characters of a stretch, and the part of held-out documents that each threshold keeps.
WINDOW, QUANTILE = 8, 0.99


def streams(texts: pa.Array, order: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, characters, offsets) of runs of texts: start marks, then words with a space after each; empty without words."""
    for first, last, data, offsets in pieces(texts, RUN):
        chars = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32).copy()
        at = offsets if len(chars) == len(data) else offsets - np.searchsorted(np.flatnonzero((data & 0xC0) == 0x80), offsets)
        chars[(chars == 0) | (chars == START)] = 1
        space = (chars == 32) | (chars - np.uint32(9) < 5)
        chars[space] = 32
        keep = ~space
        keep[1:] |= keep[:-1]  # the first space after a word
        heads = at[:-1][np.diff(at) > 0]
        keep[heads] = ~space[heads]
        kept = chars[keep]
        ends = np.searchsorted(np.flatnonzero(keep), at)
        size, ends = np.diff(ends), ends[1:]
        open_ = (size > 0) & (kept[np.maximum(ends - 1, 0)] != 32) if len(kept) else np.zeros(last - first, bool)
        out = np.concatenate(([0], np.cumsum(np.where(size > 0, size + open_ + order - 1, 0))))
        own = scored_places(out, order)
        own[out[1:][open_] - 1] = False
        stream = np.full(out[-1], START, np.uint32)
        stream[own] = kept
        stream[out[1:][open_] - 1] = 32
        yield first, last, stream, out


def scored_places(offsets: np.ndarray, order: int) -> np.ndarray:
    """For each place of a run whether it is scored: not a start mark."""
    out = np.ones(offsets[-1], bool)
    out[(offsets[:-1][np.diff(offsets) > 0, None] + np.arange(order - 1)).ravel()] = False
    return out


def _language(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def _seeds(langs: pa.Array) -> np.ndarray:
    """A number for each text's language."""
    known = langs.dictionary_encode()
    return np.array([_language(x) for x in known.dictionary.to_pylist()], np.uint64)[known.indices.to_numpy()] if len(langs) else np.zeros(0, np.uint64)


def gram_keys(grams: list[np.ndarray], seeds: np.ndarray) -> np.ndarray:
    """Hashes of n-grams, given as an array for each of their characters, with their language; three characters of 21 bits at a time."""
    with np.errstate(over="ignore"):
        total = seeds
        for i in range(0, len(grams), 3):
            packed = grams[i].astype(np.uint64)
            for c in grams[i + 1 : i + 3]:
                packed <<= U(21)
                packed |= c
            packed += total
            total = mix(packed)
        return total


def _scored(stream: np.ndarray, offsets: np.ndarray, seeds: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, hashes, cuts): the characters that are scored with the hash of the n-gram that ends there; text i has cuts[i]:cuts[i + 1]."""
    n = max(0, len(stream) - order + 1)
    place = np.flatnonzero(scored_places(offsets, order))
    keys = gram_keys([stream[i : i + n] for i in range(order)], np.repeat(seeds, np.diff(offsets))[:n])
    return place, keys[place - (order - 1)], np.searchsorted(place, offsets)


def _summed(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """(key, lang, gram, n, c) of several such tables, their counts summed up."""
    key, lang, gram, n, c = (np.concatenate(x) for x in zip(*held, strict=True))
    order, heads = grouped(key)
    at = order[heads]
    return key[at], lang[at], gram[at], np.add.reduceat(n[order], heads), np.add.reduceat(c[order], heads)


def counted(order: int, limit: int = HELD):
    """mapInArrow function: (text, lang, trains) to (lang, gram, n, c): n-grams with their occurrences, and those in training text.

    Runs of text are summed up before they are returned, while there are no more than ``limit`` rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, langs = [], 0, {}
        for batch in batches:
            trains, seeds, known = batch.column(2).to_numpy(zero_copy_only=False), _seeds(batch.column(1)), batch.column(1).dictionary_encode()
            codes = np.array([langs.setdefault(x, len(langs)) for x in known.dictionary.to_pylist()], np.int32)[known.indices.to_numpy()] if len(seeds) else np.zeros(0, np.int32)
            for first, last, stream, offsets in streams(batch.column(0), order):
                place, keys, cuts = _scored(stream, offsets, seeds[first:last], order)
                if not len(place):
                    continue
                by, heads = grouped(keys)
                at, size = by[heads], np.diff(cuts)
                c = np.add.reduceat(np.repeat(trains[first:last], size)[by].astype(np.int64), heads)
                grams = np.stack([stream[place[at] - i] for i in range(order - 1, -1, -1)], 1)
                held.append((keys[at], np.repeat(codes[first:last], size)[at], grams, np.diff(heads, append=len(by)), c))
                rows += len(at)
                if rows > limit:
                    held = [_summed(held)]
                    rows = len(held[0][0])
                    if rows > limit // 2:
                        yield table(held.pop(), langs)
                        rows = 0
        if held:
            yield table(_summed(held), langs)

    def table(summed: tuple[np.ndarray, ...], langs: dict[str, int]) -> pa.RecordBatch:
        _, lang, grams, n, c = summed
        text = pa.array(np.ascontiguousarray(grams).view(f"<U{order}").ravel())
        return pa.RecordBatch.from_arrays([pa.array(list(langs), pa.string()).take(pa.array(lang)), text, pa.array(n), pa.array(c)], names=["lang", "gram", "n", "c"])

    return run


def keyed(order: int):
    """mapInArrow function: (lang, gram, n, lp) to (key, n, lp)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = np.frombuffer("".join(batch.column(1).to_pylist()).encode("utf-32-le"), np.uint32).reshape(-1, order)
            keys = gram_keys(list(grams.T), _seeds(batch.column(0)))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), batch.column(2), batch.column(3)], names=["key", "n", "lp"])

    return run


def _discounts(counts: DataFrame) -> DataFrame:
    """lang, d1, d2, d3 from a table (lang, gram, c)."""
    n = [F.sum((F.col("c") == k).cast("long")).alias(f"n{k}") for k in (1, 2, 3, 4)]
    y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))
    d = [F.coalesce(F.greatest(F.lit(0.1), F.least(F.lit(float(k)), k - (k + 1) * y * F.try_divide(F.col(f"n{k + 1}"), F.col(f"n{k}")))), F.lit(0.5)).alias(f"d{k}") for k in (1, 2, 3)]
    return counts.filter("c > 0").groupBy("lang").agg(*n).select("lang", *d)


def _discount(c: Column) -> Column:
    return F.when(c == 0, 0.0).when(c == 1, F.col("d1")).when(c == 2, F.col("d2")).otherwise(F.col("d3"))


def gram_scores(counts: DataFrame, order: int) -> DataFrame:
    """(key, n, lp), written: ln p of the last character after the others, for each (lang, gram, n, c); c is 0 for n-grams of untrusted text.

    Each order is a plan of its own over written tables. As a single plan it had some 60 shuffles, whose threads, generated code and
    events took hundreds of MB of the driver.
    """
    tables = {order: counts}
    for n in range(order - 1, 0, -1):  # how many different characters come before each shorter n-gram in training text
        level = tables[n + 1].groupBy("lang", F.substr("gram", F.lit(2)).alias("gram")).agg(F.sum((F.col("c") > 0).cast("long")).alias("c"))
        tables[n] = materialize(level, f"grams-{n}")
    lower = None
    for n in range(1, order + 1):
        own = tables[n].join(F.broadcast(_discounts(tables[n])), "lang", "left").withColumns({"d": _discount(F.col("c")), "context": F.substr("gram", F.lit(1), F.lit(n - 1)), "rest": F.substr("gram", F.lit(2))})
        about = own.filter("c > 0").groupBy("lang", "context").agg(F.sum("c").alias("total"), F.sum("d").alias("spared"))
        if lower is None:
            alphabet = tables[1].filter("c > 0").groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
            below = own.join(F.broadcast(alphabet), "lang", "left").withColumn("p", F.lit(1.0) / (F.coalesce("v", F.lit(0)) + 1))
        else:
            below = own.join(lower.select("lang", F.col("gram").alias("rest"), "p"), ["lang", "rest"])
        p = F.when(F.col("total").isNull(), F.col("p")).otherwise((F.col("c") - F.col("d") + F.col("spared") * F.col("p")) / F.col("total"))
        asked = below.join(about, ["lang", "context"], "left").withColumn("p", p)
        if n < order:
            scores = materialize(asked.select("lang", "gram", "p"), f"p-{n}")
        else:
            scores = materialize(asked.select("lang", "gram", "n", F.log("p").alias("lp")).mapInArrow(keyed(order), "key long, n long, lp double"), "scores")
        drop_tables(*([lower] if lower is not None else []), *([tables[n]] if n < order else []))
        lower = scores
    return lower


def trusted_docs(labels: DataFrame) -> DataFrame:
    """doc_id of texts labelled good and not toxic."""
    return labels.filter((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0) & F.col("doc_id").isNotNull()).select("doc_id").distinct()


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(HELD_OUT)) == 0


class Scores:
    """Scores sent to every task, by sorted key; ``heads``: where the keys with the same first bits begin."""

    def __init__(self, keys: np.ndarray, lp: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.lp = np.append(keys[order], ~U(0)), np.append(lp[order], np.nan)
        bits = len(keys).bit_length() + 1
        self.shift = U(64 - bits)
        self.heads = np.searchsorted(self.keys[:-1] >> self.shift, np.arange(1 << bits, dtype=np.uint64)).astype(np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """ln p of each key, NaN where there is none."""
        at = self.heads[(keys >> self.shift).view(np.int64)]
        found = self.keys[at]
        out = self.lp[at]
        live = np.flatnonzero(found != keys)
        at, found = at[live], found[live]
        while len(live):
            out[live] = np.nan
            more = found < keys[live]
            live, at = live[more], at[more] + 1
            found = self.keys[at]
            same = found == keys[live]
            out[live[same]] = self.lp[at[same]]
            live, at, found = live[~same], at[~same], found[~same]
        return out


def worst_mean(x: np.ndarray, offsets: np.ndarray, window: int) -> np.ndarray:
    """The largest mean of ``window`` numbers in a row of each part; of all its numbers if there are fewer; NaN if none."""
    size = np.diff(offsets)
    sums = np.concatenate(([0.0], np.cumsum(x)))
    out = np.where(size > 0, (sums[offsets[1:]] - sums[offsets[:-1]]) / np.maximum(size, 1), np.nan)
    long = np.flatnonzero(size >= window)
    if len(long):
        starts = np.arange(max(0, len(x) - window + 1))
        means = (sums[starts + window] - sums[starts]) / window
        low, high = offsets[long], offsets[long + 1] - window + 1
        out[long] = np.maximum.reduceat(np.append(means, -np.inf), np.stack((low, high), 1).ravel())[::2]
    return out


def scored(sent, order: int, window: int):
    """mapInArrow function: (text, lang, extra: array of (key, lp) or null, doc_id) to (doc_id, n_scored, log_ppl, worst, missing).

    missing: the keys of n-grams that have no score yet; such a text's log_ppl and worst are null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seeds, extra = _seeds(batch.column(1)), batch.column(2)
            for first, last, stream, offsets in streams(batch.column(0), order):
                _, keys, cuts = _scored(stream, offsets, seeds[first:last], order)
                lp = sent.value.find(keys)
                more = extra.slice(first, last - first).flatten()
                none = np.flatnonzero(np.isnan(lp))
                if len(more) and len(none):
                    lp[none] = Scores(more.field("key").to_numpy().view(np.uint64), more.field("lp").to_numpy()).find(keys[none])
                    none = none[np.isnan(lp[none])]
                x = -lp
                owner = np.searchsorted(cuts, none, "right") - 1
                by, heads = grouped(keys[none])
                new = np.ones(len(by), bool)
                new[1:] = owner[by][1:] != owner[by][:-1]
                new[heads] = True
                once = np.sort(by[new])  # each text's missing n-grams, in the order of texts
                sizes = np.bincount(owner[once], minlength=last - first)
                whole = sizes == 0
                missing = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32), pa.array(keys[none[once]].view(np.int64)))
                x[none] = 0.0
                size = np.diff(cuts)
                means = worst_mean(x, cuts, max(len(x), 1) + 1)
                value = lambda v: pa.array(v, mask=~whole | (size == 0))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([batch.column(3).slice(first, last - first), pa.array(size.astype(np.int64)), value(means), value(worst_mean(x, cuts, window)), missing], names=["doc_id", "n_scored", "log_ppl", "worst", "missing"])

    return run


def perplexities(docs: DataFrame, trusted: DataFrame, order: int = 5, window: int = WINDOW, hot: int = HOT) -> DataFrame:
    """(doc_id, lang, trusted, n_scored, log_ppl, worst): characters that were scored, mean and worst -ln p of them."""
    spark = docs.sparkSession
    docs = one_row_per_doc(docs, columns=["text", "lang"]).select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.make_valid_utf8("text").alias("text"))
    ids = trusted.select("doc_id", F.lit(True).alias("trusted"))
    ids = F.broadcast(ids) if ids.count() <= SENT_ROWS else ids
    trains = docs.join(ids, "doc_id", "left").select("text", "lang", (F.coalesce("trusted", F.lit(False)) & ~held_out(F.col("doc_id"))).alias("trains"))
    counts = trains.mapInArrow(counted(order), "lang string, gram string, n long, c long").groupBy("lang", "gram").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))
    counts = materialize(counts, "counts")
    release(spark)
    scores = gram_scores(counts, order)
    drop_tables(counts)
    release(spark)
    often = F.col("n") >= hot_count(scores, hot=hot)
    top = scores.filter(often).select("key", "lp").toArrow()
    sent = spark.sparkContext.broadcast(Scores(top["key"].to_numpy().view(np.uint64), top["lp"].to_numpy()))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_scored long, log_ppl double, worst double, missing array<long>"
    none = F.lit(None).cast("array<struct<key:long,lp:double>>").alias("extra")
    first = materialize(docs.select("text", "lang", none, "doc_id").mapInArrow(scored(sent, order, window), schema), "scored")
    done = first.filter(F.size("missing") == 0)
    asked = first.filter(F.size("missing") > 0).select("doc_id", F.explode("missing").alias("key"))
    if asked.take(1):  # else texts would move to meet nothing
        extra = asked.join(scores.filter(~often).select("key", "lp"), "key").groupBy("doc_id").agg(F.collect_list(F.struct("key", "lp")).alias("extra"))
        done = done.unionByName(docs.join(extra, "doc_id").select("text", "lang", "extra", "doc_id").mapInArrow(scored(sent, order, window), schema))
    out = materialize(done.drop("missing"), "perplexities")
    sent.destroy()
    drop_tables(scores, first)
    release(spark)
    marked = docs.select("doc_id", "lang").join(ids, "doc_id", "left").withColumn("trusted", F.coalesce("trusted", F.lit(False)))
    return marked.join(out, "doc_id")


def classify(docs: DataFrame, labels: DataFrame, order: int = 5, quantile: float = QUANTILE, window: int = WINDOW, hot: int = HOT) -> DataFrame:
    """perplexities() with each language's thresholds and ``kept``."""
    df = perplexities(docs, trusted_docs(labels), order, window, hot)
    own = df.filter(F.col("trusted") & held_out(F.col("doc_id")) & F.col("log_ppl").isNotNull())
    at = lambda c: F.percentile_approx(c, quantile, 10_000)
    limits = materialize(own.groupBy("lang").agg(at("log_ppl").alias("threshold"), at("worst").alias("worst_threshold")), "limits")
    limits = F.broadcast(limits) if limits.count() <= SENT_ROWS else limits
    good = (F.col("log_ppl") <= F.col("threshold")) & (F.col("worst") <= F.col("worst_threshold"))
    return df.join(limits, "lang", "left").withColumn("kept", F.coalesce(good, F.lit(True)))


def keep_good(docs: DataFrame, labels: DataFrame, order: int = 5, quantile: float = QUANTILE, window: int = WINDOW) -> DataFrame:
    """``docs`` without the documents that the classifier rejects."""
    docs = one_row_per_doc(docs)
    return docs.join(classify(docs, labels, order, quantile, window).filter("kept").select("doc_id"), "doc_id", "left_semi")
