"""Benchmark decontamination by greedy string tiling: finds test passages in texts even if their parts come in another order.

Tokens are words ``[^\\x20\\x09-\\x0D]+``, A-Z folded, without the marks ``EDGE`` at either end. Texts and test items are joined
on shared seeds (``min_match`` tokens); around a pair's seeds, running Karp-Rabin greedy string tiling marks the longest
matches of unmarked tokens first, round by round. An item leaks into a text if tiles cover
``min_cover`` of its tokens or more. Items of under ``min_match`` tokens, which any text may have by chance, leak only into texts
of the same tokens.

The benchmark is taken in blocks of ``block`` items (hashed by id), each small enough to be sent to every task; every text
meets every block, texts are never shuffled, and a hot passage is work within each text's own task. Matches below
``min_match`` tokens make no tile, so a text of any length is read once and tiled only where seeds are.

Null or empty texts and items match nothing. Rows: repeated ids and null ids as in ``common``, in either table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spreadrank.llm.bytes_np import BASE, U, mix, pieces, powers, word_hashes
from spreadrank.llm.common import one_row_per_doc

#: Marks cut from both ends of words.
EDGE = ".,;:!?\"'()[]"
_EDGE = np.zeros(256, bool)
_EDGE[list(EDGE.encode())] = True


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of texts; marks at the end or start of a word, however many, are read as spaces (marks inside words stay)."""
    space, mark = (data == 32) | (data >= 9) & (data <= 13), _EDGE[data]
    if mark.any():
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        first = np.flatnonzero(mark & (np.concatenate(([True], ~mark[:-1])) | edge[:-1]))
        last = np.flatnonzero(mark & (np.concatenate((~mark[1:], [True])) | edge[1:]))
        before = edge[first] | np.concatenate(([True], space))[first]
        after = edge[last + 1] | np.concatenate((space, [True]))[last + 1]
        run = np.zeros(len(data) + 1, np.int64)  # a run of marks that touches a gap is one
        np.add.at(run, first[before | after], 1)
        np.add.at(run, last[before | after] + 1, -1)
        space = space | (np.cumsum(run[:-1]) > 0)
    return word_hashes(np.where(space, np.uint8(32), data), offsets)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Rolling Karp-Rabin hashes of all n neighbouring tokens, modulo 2**64."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * powers(BASE, len(hashes))[: len(hashes)], dtype=np.uint64, out=sums[1:])
        return mix((sums[n:] - sums[:-n]) * powers(pow(BASE, -1, 1 << 64), len(hashes))[: len(hashes) - n + 1])


def tile(item: np.ndarray, text: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """Tiles (place in item, place in text, tokens): no token is in two; the longest matches are marked first, ties from the left."""
    n, m = len(item), len(text)
    used_a, used_b = np.zeros(n, bool), np.zeros(m, bool)
    table: dict[int, list[int]] = {}
    for i, h in enumerate(grams(item, min_match).tolist()):
        table.setdefault(h, []).append(i)
    rolled = grams(text, min_match)
    starts = np.flatnonzero(np.isin(rolled, np.array(list(table), np.uint64))).tolist() if table else []
    pairs, tiles = [(i, j) for j in starts for i in table[int(rolled[j])]], []
    while pairs and not used_a.all():
        found = []
        for i, j in pairs:
            if i and j and not used_a[i - 1] and not used_b[j - 1] and item[i - 1] == text[j - 1]:
                continue  # part of a match that starts earlier
            k = 0
            while i + k < n and j + k < m and not used_a[i + k] and not used_b[j + k] and item[i + k] == text[j + k]:
                k += 1
            if k >= min_match:
                found.append((k, i, j))
        longest = max(found, default=(0,))[0]
        if not longest:
            break
        for k, i, j in sorted(found, key=lambda x: x[1:]):
            if k == longest and not used_a[i : i + k].any() and not used_b[j : j + k].any():
                used_a[i : i + k] = used_b[j : j + k] = True
                tiles.append((i, j, k))
        pairs = [(i, j) for i, j in pairs if not used_a[i] and not used_b[j]]
    return tiles


class Seeds:
    """The seeds of a block of items, sorted for joins."""

    def __init__(self, items: list[tuple[int, str]], min_match: int):
        self.min_match, self.ids, self.items = min_match, [i for i, _ in items], []
        found: dict[int, list[tuple[np.ndarray, int]]] = {}
        for at, (_, text) in enumerate(items):
            raw = np.frombuffer((text or "").encode(), np.uint8)
            h, _ = tokens(raw, np.array([0, len(raw)]))
            self.items.append(h)
            n = min(min_match, len(h))
            if n:
                found.setdefault(n, []).append((np.unique(grams(h, n)), at))
        self.tables = {}
        for n, lists in found.items():
            keys, own = np.concatenate([k for k, _ in lists]), np.repeat([a for _, a in lists], [len(k) for k, _ in lists])
            order = np.argsort(keys, kind="stable")
            self.tables[n] = (keys[order], own[order])

    def leaks(self, text: np.ndarray) -> list[tuple[int, float]]:
        """(item, covered part) for each item that shares a seed with the text."""
        places: dict[int, list[tuple[int, int]]] = {}
        for n, (keys, own) in self.tables.items():
            if n < self.min_match and n != len(text):
                continue
            h = grams(text, n)
            low = np.searchsorted(keys, h, "left")
            for j in np.flatnonzero(keys[np.minimum(low, len(keys) - 1)] == h):
                i = int(low[j])
                while i < len(keys) and keys[i] == h[j]:
                    places.setdefault(int(own[i]), []).append((int(j), n))
                    i += 1
        out = []
        for at, seeds in places.items():
            item = self.items[at]
            keep = np.zeros(len(text), bool)
            for j, n in seeds:
                keep[max(0, j - len(item)) : j + len(item) + n] = True
            # Regions are set apart by a token that no item has, so no match runs over a gap.
            where = np.flatnonzero(keep)
            cut = np.flatnonzero(np.diff(where) > 1) + 1
            part = np.insert(text[where], cut, U(0)) if len(cut) else text[where]
            covered = sum(k for _, _, k in tile(item, part, min(self.min_match, len(item))))
            out.append((self.ids[at], covered / len(item)))
        return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, min_match: int = 5, min_cover: float = 0.5, block: int = 20_000) -> DataFrame:
    """(doc_id, items array<long>, coverage double): the items that leak into each text, and the largest covered part of any."""
    docs = one_row_per_doc(docs, columns=["text"]).select("doc_id", "text")
    items = one_row_per_doc(benchmark, "item_id", ["text"]).select("item_id", "text")
    blocks = max(1, -(-items.count() // block))

    def found(b: int) -> DataFrame:
        seeds = Seeds([tuple(r) for r in items.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).sort("item_id").toLocalIterator()], min_match)

        def run(batches):
            for batch in batches:
                ids, cover = [], []
                for _, _, data, offsets in pieces(batch.column(1)):
                    hashes, where = tokens(data, offsets) if len(data) else (np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64))
                    for a, z in zip(where[:-1], where[1:], strict=True):
                        leaks = seeds.leaks(hashes[a:z])
                        ids.append(sorted(i for i, c in leaks if c >= min_cover))
                        cover.append(max((c for _, c in leaks), default=0.0))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int64())), pa.array(cover, pa.float64())], names=["doc_id", "items", "coverage"])

        return docs.mapInArrow(run, "doc_id long, items array<long>, coverage double")

    if blocks == 1:
        return found(0)
    out = found(0)
    for b in range(1, blocks):
        out = out.unionByName(found(b))
    return out.groupBy("doc_id").agg(F.array_sort(F.flatten(F.collect_list("items"))).alias("items"), F.max("coverage").alias("coverage"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, min_match: int = 5, min_cover: float = 0.5, block: int = 20_000) -> DataFrame:
    """``docs`` without the documents into which an item leaks; all others stay, unchanged."""
    docs = one_row_per_doc(docs)
    clean = find_leaks(docs, benchmark, min_match, min_cover, block).filter(F.size("items") == 0).select("doc_id")
    return docs.join(clean, "doc_id", "left_semi")
