"""Suffix-array dedup: maximal repeat groups from the common-prefix intervals of an enhanced, sparse suffix array.

Texts are UTF-8 bytes; a repeat is ``length`` bytes or more found at several places of one or several documents.

1. Anchors: of each ``length`` neighbouring bytes the ``SEED``-byte gram with the least hash (leftmost of equals). Equal
   strings have the same anchor at the same offset, so it is enough to sort the suffixes that start at anchors, and only
   those whose gram occurs again. What lies around an anchor, within the strings of ``length`` bytes that hold it, is its context.
2. Anchors with equal contexts are one entry, its first place; the strings through the other places all start earlier as
   well. This is an aggregate, so a passage that very many documents share is combined before the shuffle.
3. For each gram the suffixes from its entries are sorted, with the longest common prefixes of neighbours (the enhanced
   suffix array of that part). A stack scan gives the intervals that share a prefix (right-maximal repeats). In each
   interval the left contexts are sorted and scanned alike, and a set of places that differ to the left and to the right is
   a maximal repeat group: all its places, not just neighbours, are in it. Every place but a group's first is covered.
4. Grams with more than ``crowd`` entries are not brought into one task: each string of ``length`` bytes through such an
   anchor is a key of its own, with its first place from an aggregate (exact as well).

Contexts are bounded (under 2 * length bytes), so no task holds a text more than once. Hashes of 64 bits stand for equal
contexts and, for crowded grams, equal strings. Null and empty texts have no bytes; texts of under ``length`` bytes lose
nothing. Repeated rows and null ids as in ``common``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spreadrank.llm.bytes_np import BASE, BYTE, STEP, U, mix, pieces, powers
from spreadrank.llm.common import drop_tables, materialize, one_row_per_doc, release

SEED = 24


def prefix_sums(data: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE[data] * powers(BASE, len(data))[: len(data)], dtype=np.uint64, out=sums[1:])
    return sums


def spans_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of data[starts:ends]; equal strings have equal hashes wherever they are."""
    with np.errstate(over="ignore"):
        return mix((sums[ends] - sums[starts]) * powers(pow(BASE, -1, 1 << 64), len(sums))[starts] + (ends - starts).astype(np.uint64) * STEP)


def least_of_windows(h: np.ndarray, width: int) -> np.ndarray:
    """Places of the least value of each ``width`` neighbours, the leftmost of equals; each place once, in order."""
    at, value, span = np.arange(len(h)), h, 1
    while span < width:
        step = min(span, width - span)
        left, right = value[: len(value) - step], value[step:]
        take = right < left
        at = np.where(take, at[step:], at[: len(at) - step])
        value = np.where(take, right, left)
        span += step
    return np.unique(at)


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(text, places, gram hashes, context hashes) for each text of ``length`` bytes or more."""
    with np.errstate(over="ignore"):
        sums = prefix_sums(data)
        grams = spans_hash(sums, np.arange(0, len(data) - SEED + 1), np.arange(SEED, len(data) + 1)) if len(data) >= SEED else np.zeros(0, np.uint64)
        for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
            if b - a < length:
                continue
            at = least_of_windows(grams[a : b - SEED + 1], length - SEED + 1) + a
            low, high = np.maximum(a, at - (length - SEED)), np.minimum(b, at + length)
            context = mix(spans_hash(sums, low, high) + (at - low).astype(np.uint64) * STEP)
            yield i, at - a, grams[at], context


def lcp_intervals(lcp: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(depth, first, last) of the intervals of a common-prefix array with depth >= least; lcp[i] is between i and i + 1.

    A stack holds the open intervals by rising depth; a smaller value closes the deeper ones, so children come before parents.
    """
    out, stack = [], []
    for i, d in enumerate([*lcp.tolist(), -1]):
        first = i
        while stack and stack[-1][0] > d:
            depth, first = stack.pop()
            if depth >= least:
                out.append((depth, first, i))
        if d >= 0 and (not stack or stack[-1][0] < d):
            stack.append((d, first))
    return out


def by_bytes(rows: np.ndarray) -> np.ndarray:
    """The order of rows of bytes that end in zeros; 1 has been added to each byte of theirs (UTF-8 has no byte 255)."""
    return np.argsort(np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel(), kind="stable")


def common(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Lengths of the common starts of the rows of a and b, n at most."""
    differ = a != b
    return np.minimum(np.where(differ.any(1), differ.argmax(1), a.shape[1]), n)


def maximal_groups(left: np.ndarray, left_n: np.ndarray, right: np.ndarray, right_n: np.ndarray, length: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(bytes to the left, bytes to the right, places) of the maximal repeat groups of one gram's places.

    left and right: contexts as rows of bytes, left ones read backwards; left_n, right_n: how long they are.
    """
    m = len(right)
    order = by_bytes(right)
    lcp = common(right[order[:-1]], right[order[1:]], np.minimum(right_n[order[:-1]], right_n[order[1:]]))
    by_left = by_bytes(left)
    place = np.empty(m, np.int64)
    place[order] = np.arange(m)
    for depth, first, last in lcp_intervals(lcp, SEED):
        if depth + left.shape[1] < length:
            continue
        own = by_left[(place[by_left] >= first) & (place[by_left] <= last)]
        left_lcp = common(left[own[:-1]], left[own[1:]], np.minimum(left_n[own[:-1]], left_n[own[1:]]))
        child = np.concatenate(([0], np.cumsum(lcp[first:last] == depth)))  # which way a suffix goes on to the right
        for deep, a, b in lcp_intervals(left_lcp, max(0, length - depth)):
            members = own[a : b + 1]
            ways = child[place[members] - first]
            if ways.min() != ways.max():
                yield deep, depth, members


def covered(doc: np.ndarray, pos: np.ndarray, left: np.ndarray, left_n: np.ndarray, right: np.ndarray, right_n: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """(place, start, end): what the maximal repeat groups cover at places other than the group's first."""
    out: dict[tuple[int, int], int] = {}
    rank = np.empty(len(doc), np.int64)
    rank[np.lexsort((pos, doc))] = np.arange(len(doc))
    for deep, depth, members in maximal_groups(left, left_n, right, right_n, length):
        first = members[np.argmin(rank[members])]
        for i in members.tolist():
            if i != first:
                out[i, depth] = max(out.get((i, depth), 0), deep)
    return [(i, int(pos[i]) - deep, int(pos[i]) + depth) for (i, depth), deep in out.items()]


def repeated_spans(docs: DataFrame, length: int = 100, crowd: int = 1000) -> DataFrame:
    """(doc_id, start, end): bytes that lie in a string of ``length`` bytes which also starts earlier; spans may overlap."""
    spark = docs.sparkSession
    reach = length - SEED

    def grams(batches):
        for batch in batches:
            for _, _, data, offsets in pieces(batch.column(0)):
                found = [g for _, _, g, _ in anchors(data, offsets, length)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], names=["g"])

    def places(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for first, last, data, offsets in pieces(batch.column(1)):
                sizes, found = np.diff(offsets), list(anchors(data, offsets, length))
                if not found:
                    continue
                own = np.repeat([i for i, *_ in found], [len(at) for _, at, _, _ in found])
                at, g, c = (np.concatenate([x[k] for x in found]) for k in (1, 2, 3))
                at = at.astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(c.view(np.int64)), pa.array(ids[first:last][own].astype(np.int64)), pa.array(at), pa.array(np.minimum(sizes[own], at + length).astype(np.int64))], names=["g", "c", "doc_id", "pos", "stop"])

    texts = docs.filter(F.octet_length("text") >= length)
    again = texts.select("text").mapInArrow(grams, "g long").groupBy("g").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("g")
    again = materialize(again, "grams")
    release(spark)
    found = texts.select("doc_id", "text").mapInArrow(places, "g long, c long, doc_id long, pos long, stop long")
    held = materialize(found.join(again, "g"), "anchors")
    release(spark)
    entries = materialize(held.groupBy("g", "c").agg(F.min(F.struct("doc_id", "pos")).alias("at"), F.count(F.lit(1)).alias("n")), "entries")
    other = held.join(entries.filter("n > 1").select("g", "c", "at"), ["g", "c"]).filter(F.struct("doc_id", "pos") > F.col("at"))
    whole = other.select("doc_id", F.greatest(F.col("pos") - reach, F.lit(0)).alias("start"), F.col("stop").alias("end"))
    several = entries.groupBy("g").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
    asked = entries.join(several, "g").select(F.col("at.doc_id").alias("doc_id"), "at.pos", "g", (F.col("k") > crowd).alias("crowded"))
    asked = materialize(asked.groupBy("doc_id").agg(F.collect_list(F.struct("pos", "g", "crowded")).alias("places")), "asked")
    contexts = "g long, doc_id long, pos long, left binary, right binary, crowded boolean"

    def cut(batches):
        for batch in batches:
            for doc, text, at in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                data = np.frombuffer(text.as_buffer(), np.uint8)
                v = at.values
                pos, g, crowded = (v.field(k).to_numpy(zero_copy_only=False) for k in range(3))
                low, high = np.maximum(pos - reach, 0), np.minimum(pos + length, len(data))
                raw = data.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(g), pa.array(np.full(len(g), doc)), pa.array(pos), pa.array([raw[a:p] for a, p in zip(low, pos, strict=True)], pa.binary()), pa.array([raw[p:b] for p, b in zip(pos, high, strict=True)], pa.binary()), pa.array(crowded)],
                    names=["g", "doc_id", "pos", "left", "right", "crowded"],
                )

    joined = docs.select("doc_id", "text").join(asked, "doc_id").select("doc_id", "text", "places")
    cuts = materialize(joined.mapInArrow(_gathered(cut), contexts), "contexts")
    release(spark)

    def scan(batches):
        for table in _by_gram(batches):
            yield from _scan(table, length)

    dealt = cuts.filter("not crowded").drop("crowded")
    tree = dealt.repartition("g").sortWithinPartitions("g").mapInArrow(scan, "doc_id long, start long, end long")

    def strings(batches):
        for batch in batches:
            docs_, at, lefts, rights = batch.column(0), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for doc, pos, left, right in zip(docs_.to_pylist(), at.to_pylist(), lefts, rights, strict=True):
                data = np.frombuffer(left + right, np.uint8)
                starts = np.arange(0, min(len(left), len(data) - length) + 1)
                with np.errstate(over="ignore"):
                    keys = spans_hash(prefix_sums(data), starts, starts + length).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.full(len(keys), doc)), pa.array(starts + pos - len(left))], names=["key", "doc_id", "start"])

    keyed = cuts.filter("crowded").select("doc_id", "pos", "left", "right").mapInArrow(_gathered(strings), "key long, doc_id long, start long")
    heads = keyed.groupBy("key").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", "first")
    dense = keyed.join(heads, "key").filter(F.struct("doc_id", "start") > F.col("first")).select("doc_id", "start", (F.col("start") + length).alias("end"))
    spans = whole.unionByName(tree).unionByName(dense)
    out = materialize(spans.groupBy("doc_id", "start").agg(F.max("end").alias("end")), "spans")
    drop_tables(again, held, entries, asked, cuts)
    release(spark)
    return out


def _gathered(f, rows: int = 5000):
    """f's many small batches as fewer larger ones."""

    def g(batches):
        held, n = [], 0
        for b in f(batches):
            held.append(b)
            n += b.num_rows
            if n >= rows:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return g


def _by_gram(batches, rows: int = 20_000) -> Iterator[pa.Table]:
    """Tables of whole grams, of about ``rows`` rows, from batches sorted by gram."""
    held, n = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.num_rows
        if n >= rows:
            table = pa.Table.from_batches(held)
            g = table["g"].to_numpy()
            stop = int(np.flatnonzero(g != g[-1])[-1]) + 1 if g[0] != g[-1] else 0
            if stop:
                yield table.slice(0, stop)
            held = table.slice(stop).combine_chunks().to_batches()
            n = table.num_rows - stop
    if held:
        yield pa.Table.from_batches(held)


def _scan(table: pa.Table, length: int) -> Iterator[pa.RecordBatch]:
    table = table.combine_chunks()
    g, doc, pos = (table[k].to_numpy() for k in ("g", "doc_id", "pos"))
    reach = length - SEED
    ls, rs = table["left"].to_pylist(), table["right"].to_pylist()
    left = np.frombuffer(b"".join(x[::-1].ljust(reach, b"\0") for x in ls), np.uint8).reshape(-1, reach)
    right = np.frombuffer(b"".join(x.ljust(length, b"\0") for x in rs), np.uint8).reshape(-1, length)
    left_n, right_n = np.array([len(x) for x in ls]), np.array([len(x) for x in rs])
    left, right = (rows + (np.arange(rows.shape[1]) < n[:, None]).astype(np.uint8) for rows, n in ((left, left_n), (right, right_n)))
    heads = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
    sizes = np.diff(np.concatenate((heads, [len(g)])))
    two = heads[sizes == 2]
    spans = []
    if len(two):  # a group of two suffixes has one interval: no sort, no stack
        deep = common(left[two], left[two + 1], np.minimum(left_n[two], left_n[two + 1]))
        depth = common(right[two], right[two + 1], np.minimum(right_n[two], right_n[two + 1]))
        later = np.where((doc[two] > doc[two + 1]) | (doc[two] == doc[two + 1]) & (pos[two] > pos[two + 1]), two, two + 1)
        ok = deep + depth >= length
        later, deep, depth = later[ok], deep[ok], depth[ok]
        spans.append((doc[later], pos[later] - deep, pos[later] + depth))
    more = []
    for a, n in zip(heads[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
        s = slice(a, a + n)
        more += [(int(doc[a + i]), x, y) for i, x, y in covered(doc[s], pos[s], left[s], left_n[s], right[s], right_n[s], length)]
    if more:
        spans.append(tuple(np.array(x, np.int64) for x in zip(*more, strict=True)))
    if spans:
        d, x, y = (np.concatenate([s[k] for s in spans]).astype(np.int64) for k in range(3))
        yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(x), pa.array(y)], names=["doc_id", "start", "end"])


def union(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of overlapping or touching spans."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate(([True], starts[1:] > reach[:-1]))
    heads = np.flatnonzero(new)
    return starts[heads], reach[np.concatenate((heads[1:] - 1, [len(starts) - 1]))]


def remove_repeats(docs: DataFrame, length: int = 100, crowd: int = 1000) -> DataFrame:
    """(doc_id, kept binary, n_bytes, starts, ends): each text without its repeated bytes, and the maximal removed runs."""
    if length < SEED:
        raise ValueError(f"length must be {SEED} or more")
    docs = one_row_per_doc(docs, columns=["text"]).select("doc_id", "text")
    spans = repeated_spans(docs, length, crowd).groupBy("doc_id").agg(F.collect_list("start").alias("s"), F.collect_list("end").alias("e"))

    def apply(batches):
        for batch in batches:
            out = []
            for text, s, e in zip(batch.column(1), batch.column(2), batch.column(3), strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                if s.is_valid:
                    x, y = union(s.values.to_numpy(), e.values.to_numpy())
                    edges = np.concatenate(([0], np.stack((x, y), 1).ravel(), [len(raw)])).tolist()
                    kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                else:
                    x = y = np.zeros(0, np.int64)
                    kept = raw
                out.append((kept, len(raw), x, y))
            kept, size, x, y = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary()), pa.array(size, pa.int64()), pa.array(x, pa.list_(pa.int64())), pa.array(y, pa.list_(pa.int64()))], names=["doc_id", "kept", "n_bytes", "starts", "ends"])

    return docs.join(spans, "doc_id", "left").select("doc_id", "text", "s", "e").mapInArrow(apply, "doc_id long, kept binary, n_bytes long, starts array<long>, ends array<long>")

