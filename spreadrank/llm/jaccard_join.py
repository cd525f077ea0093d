"""N-gram Jaccard join by vertical partitioning: one class for the texts that are linked, exact and without all pairs.

A text is the set of its ``n``-word shingles (A-Z folded), as 64-bit hashes. Hash order is the global order of n-grams; the
same cuts through it give every text the same fragments.

1. Texts with equal sets are one node (a copy is never compared).
2. Two sets whose Jaccard is at least ``t`` differ in at most ``s(1-t)/t`` n-grams (s: the smaller size), and each of these spoils one
   fragment. With 2**j fragments, j from the size, a set nearly always has more filled fragments than that; if not, it is cut finer as
   well until it has. So linked texts share a filled fragment at a level that both use: fragments are keys of an
   equi-join. A set shares at least as many fragments as it has beyond the most differences; one that shares fewer has no
   link and goes, so that frequent lines alone don't bring texts together.
3. Nodes that share a key are chained to the key's least node: candidate clusters (connected components of these stars).
4. Each cluster is checked in blocks of about ``block`` nodes: fragment by fragment the partial overlaps are counted (a matrix product
   over the fragment's n-grams) and summed for each pair. A task returns only links that join two of its trees, at most one
   less than its nodes. A cluster of several blocks has up to HUBS nodes in all of them, those that share most keys, which
   nearly always tie it together; what stays apart from its largest tree is then checked against all of the cluster, again in
   blocks. No cluster is in one task, no pair of a cluster is a row, and sets are sent once but for hubs and what is apart.
5. Components of the links; the class is named by its least ``doc_id``.

Exact up to collisions of 64-bit hashes. Null and empty texts have no n-grams and are linked with nothing; repeated rows
and null ids as in ``common``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spreadrank.llm.bytes_np import STEP, U, mix, pieces, shingles, word_hashes
from spreadrank.llm.common import drop_tables, materialize, one_row_per_doc, release
from spreadrank.llm.components import components


#: Nodes of a large cluster that every one of its blocks gets.
HUBS = 4


def shingle_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted set of shingle hashes of each text."""
    for _, _, data, offsets in pieces(texts):
        hashes, where = word_hashes(data, offsets)
        for a, b in zip(where[:-1], where[1:], strict=True):
            yield np.unique(shingles(hashes[a:b], n))


def identity(s: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart."""
    with np.errstate(over="ignore"):
        a, b = mix(s + STEP).sum(dtype=np.uint64), mix(mix(s) * STEP).sum(dtype=np.uint64)
    return int(np.int64(a.astype(np.int64))), int(np.int64(b.astype(np.int64)))


def most_differing(size: int, percent: int) -> int:
    """How many n-grams a set of this size and a linked one can differ in at most."""
    return size * (100 - percent) // percent


def per_fragment(percent: int) -> float:
    """The most n-grams a fragment may hold on average, so that filled fragments outnumber differences with room to spare."""
    r, most = (100 - percent) / percent, 8.0
    while most > 1 and 1 - np.exp(-most) < 1.2 * r * most:
        most -= 0.1
    return most


def fragment_keys(s: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, level, need) of a sorted set's filled fragments, at each level that a linked set may share with it.

    Of linked sizes a <= b, b is at most 100 a / percent: both emit the levels of a and of b. Levels go on until the filled
    fragments outnumber the differences, so the level where one of the two gets there first is one that both emit. need: how
    many of a level's fragments a linked set that emits the level has as well, at least.
    """
    n = len(s)
    if not n:
        return s, np.zeros(0, np.int32), np.zeros(0, np.int32)
    most, out = per_fragment(percent), []
    at = lambda size: max(0, int(np.ceil(np.log2(max(1, size) / most))))
    level, own, last, passed = at(-(-n * percent // 100)), at(n), at(n * 100 / percent), False
    while level <= last or not passed:
        frag = s >> U(64 - level) if level else np.zeros(n, np.uint64)
        heads = np.flatnonzero(np.concatenate(([True], frag[1:] != frag[:-1])))
        with np.errstate(over="ignore"):
            body = np.add.reduceat(mix(s * STEP), heads)
            key = mix(mix(body + frag[heads]) + U(level + 1) * STEP)
        spare = len(heads) - most_differing(n, percent)
        out.append((key, np.full(len(heads), level, np.int32), np.full(len(heads), max(1, spare), np.int32)))
        passed = passed or level >= own and spare > 0
        level += 1
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def check_block(sets: list[np.ndarray], names: list[int], side: list[int], percent: int) -> list[tuple[int, int]]:
    """Links that make a forest over the nodes; side: pairs within one side of 0 and 1 are left to other tasks unless all are 0."""
    m, root = len(sets), list(range(len(sets)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    sizes = np.array([len(s) for s in sets], np.int64)
    both = np.zeros((m, m), np.float64)
    tokens, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(m), sizes)
    shared = count[at] > 1
    number = np.cumsum(count > 1) - 1
    cols, owner = number[at[shared]], owner[shared]
    order = np.argsort(cols, kind="stable")
    cols, owner = cols[order], owner[order]
    width, total = 2048, int((count > 1).sum())
    for low in range(0, total, width):  # a fragment of the n-gram order: partial overlaps, summed for each pair
        a, b = np.searchsorted(cols, [low, low + width])
        part = np.zeros((m, width), np.float32)
        part[owner[a:b], cols[a:b] - low] = 1
        both += part @ part.T
    ok = 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)
    if any(side):
        s = np.array(side)
        ok &= s[:, None] != s[None, :]
    links = []
    for i, j in zip(*np.nonzero(np.triu(ok, 1)), strict=True):
        x, y = find(int(i)), find(int(j))
        if x != y:
            root[max(x, y)] = min(x, y)
            links.append((names[int(i)], names[int(j)]))
    return links


def jaccard_classes(docs: DataFrame, n: int = 5, percent: int = 80, block: int = 256) -> DataFrame:
    """(doc_id, n_shingles, component_id): the class of each document under links of Jaccard >= percent / 100."""
    spark = docs.sparkSession
    docs = one_row_per_doc(docs, columns=["text"]).select("doc_id", "text")

    def identities(batches):
        for batch in batches:
            rows = [(len(s), *identity(s)) for s in shingle_sets(batch.column(1), n)]
            size, x, y = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["doc_id", "n_shingles", "x", "y"])

    def keys(batches):
        for batch in batches:
            out = []
            for s in shingle_sets(batch.column(0), n):
                key, level, need = fragment_keys(s, percent)
                out.append((key, np.full(len(key), identity(s)[0] if len(s) else 0, np.int64), level, need))
            if out:
                key, node, level, need = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(node), pa.array(level), pa.array(need)], names=["key", "node", "level", "need"])

    sets = materialize(docs.mapInArrow(identities, "doc_id long, n_shingles long, x long, y long"), "sets")
    same = ["n_shingles", "x", "y"]
    firsts = sets.filter("n_shingles > 0").groupBy(*same).agg(F.min("doc_id").alias("first"))
    named = docs.select("text").mapInArrow(keys, "key long, node long, level int, need int")
    shared = lambda rows: rows.groupBy("key").agg(F.min("node").alias("head"), F.max("node").alias("last")).filter("head < last").select("key", "head")
    held = materialize(named.join(shared(named).select("key"), "key").distinct(), "shared-fragments")
    release(spark)
    for _ in range(2):  # who shares too few fragments goes, then who shared them with those
        enough = held.groupBy("node", "level").agg(F.count(F.lit(1)).alias("k"), F.max("need").alias("least")).filter("k >= least").select("node", "level")
        left = held.join(enough, ["node", "level"], "left_semi")
        new = materialize(left.join(shared(left).select("key"), "key"), "shared-fragments")
        drop_tables(held)
        held = new
    stars = held.join(shared(held), "key").filter("node > head").groupBy("head", "node").agg(F.count(F.lit(1)).alias("k"))
    stars = materialize(stars, "stars")
    release(spark)
    clusters = materialize(components(stars, "head", "node"), "clusters")
    sizes = clusters.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
    clusters = clusters.join(sizes, "component").withColumn("b", F.pmod(F.xxhash64("node"), "blocks"))
    degrees = stars.select(F.explode(F.array(F.struct(F.col("head").alias("node"), "k"), F.struct("node", "k"))).alias("e")).groupBy("e.node").agg(F.sum("e.k").alias("k"))
    hubs = clusters.filter("blocks > 1").join(degrees, "node").groupBy("component", F.pmod(F.xxhash64("node", F.lit(1)), F.lit(HUBS)).alias("h")).agg(F.max(F.struct("k", "node")).alias("m"))
    clusters = clusters.join(hubs.select(F.col("m.node").alias("node"), F.lit(True).alias("hub")), "node", "left").withColumn("hub", F.coalesce("hub", F.lit(False)))
    chosen = materialize(firsts.select("first", F.col("x").alias("node")).join(clusters, "node").select(F.col("first").alias("doc_id"), "component", "blocks", "b", "hub"), "chosen")

    def set_column(batches):
        for batch in batches:
            found = [pa.array(s.view(np.int64)) for s in shingle_sets(batch.column(0), n)]
            lists = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32), pa.concat_arrays(found) if found else pa.array([], pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], lists], names=["doc_id", "component", "places", "s"])

    def checked(pdf: pd.DataFrame) -> pd.DataFrame:
        found = [np.asarray(s, np.int64).view(np.uint64) for s in pdf["s"]]
        return pd.DataFrame(check_block(found, pdf["doc_id"].tolist(), pdf["side"].tolist(), percent), columns=["a", "b"], dtype="int64")

    def links(members: DataFrame, label: str) -> DataFrame:
        """Links found in the tasks of ``members`` (doc_id, component, places: tasks and sides)."""
        held = members.join(docs, "doc_id").select("text", "doc_id", "component", "places").mapInArrow(set_column, "doc_id long, component long, places array<struct<task:string,side:int>>, s array<long>")
        tasks = held.select("component", F.explode("places").alias("p"), "doc_id", "s").select("component", "p.task", "p.side", "doc_id", "s")
        return materialize(tasks.groupBy("component", "task").applyInPandas(checked, "a long, b long"), label)

    place = lambda task, side: F.struct(task.cast("string").alias("task"), F.lit(side).alias("side"))
    every = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    first_links = links(chosen.select("doc_id", "component", F.transform(F.when(F.col("hub"), every(F.col("blocks"))).otherwise(F.array("b")), lambda o: place(o, 0)).alias("places")), "links")
    trees = materialize(components(first_links), "trees")
    wide = chosen.filter("blocks > 1").join(trees.withColumnsRenamed({"node": "doc_id", "component": "tree"}), "doc_id", "left").withColumn("tree", F.coalesce("tree", "doc_id"))
    counts = wide.groupBy("component", "tree").agg(F.count(F.lit(1)).alias("k"))
    main = counts.groupBy("component").agg(F.max(F.struct("k", "tree")).alias("m"), F.sum("k").alias("n")).filter("n > m.k").select("component", F.col("m.tree").alias("main"), F.ceil((F.col("n") - F.col("m.k")) / block).alias("parts"))
    open_ = materialize(wide.join(main, "component").select("doc_id", "component", "blocks", "b", "parts", (F.col("tree") != F.col("main")).alias("apart"), F.pmod(F.xxhash64("doc_id", F.lit(2)), "parts").alias("part")), "open")
    found = first_links
    if open_.take(1):
        name = lambda part, b: F.concat(part.cast("string"), F.lit("-"), b.cast("string"))
        as_all = F.transform(every(F.col("parts")), lambda q: place(name(q, F.col("b")), 1))
        as_apart = F.when(F.col("apart"), F.transform(every(F.col("blocks")), lambda b: place(name(F.col("part"), b), 0))).otherwise(F.slice(as_all, 1, 0))
        found = first_links.unionByName(links(open_.select("doc_id", "component", F.concat(as_all, as_apart).alias("places")), "more-links"))
    release(spark)
    classes = materialize(components(found), "classes").withColumnsRenamed({"node": "first", "component": "c"})
    named = firsts.join(classes, "first", "left").select(*same, F.coalesce("c", "first").alias("component_id"))
    out = sets.join(named, same, "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    drop_tables(held, stars, trees, open_)
    return out


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The documents that are the least of their class; rows without a ``doc_id`` go."""
    docs = one_row_per_doc(docs)
    first = jaccard_classes(docs, n, percent).filter("doc_id = component_id").select("doc_id")
    return docs.join(first, "doc_id", "left_semi")
