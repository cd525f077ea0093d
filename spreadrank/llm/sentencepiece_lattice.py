"""SentencePiece encoding and decoding as a lattice over the different words of a corpus.

1. A text gets its leading space (``▁`` counts as a space) and is cut into words before each run of spaces and around new
   lines. No piece of the model lies across such a cut (checked when it is loaded), so each different word is encoded once.
   Words are counted by their 64-bit hashes and summed up within tasks, then by Spark.
2. Lattice: sorted words make a trie in each block of BLOCK words. For every node, the substrings that end there, up to the
   longest piece, are exploded, equi-joined to the piece table by hash and length, and grouped by node: these are
   edges (score, node where the piece starts, id), columns of Arrow batches, one row a block. A prefix that words share is joined once.
3. Viterbi: Spark's ``aggregate`` folds a block's nodes in order. The state has each node's best sum of scores and the edge it
   came by (ties: the longest last piece), and the ids of a word are read back from its last node.
4. Frequent words, HOT at most, are sent to every task as numbers; texts become sequences of numbers in place. The other
   words are joined to their ids on the word's 64-bit hash and brought to their documents in order, where all ids are put together.

The path is the model's best under its own scores, as in a unigram model (for the same scores, the ``sentencepiece`` library
gives the same ids). A BPE model's own encoder merges pair by pair instead; see the README.

A character without a piece costs 10 more than the least score and becomes bytes, or the unknown id. Null texts have null,
empty ones no ids; words of any length take the same way, a word of n characters copies n * n / 2 numbers in the fold.
Decoding looks ids up in the pieces, joins their bytes in order and removes the leading space; decode(encode(x)) is x, but
for ``▁`` in a text, which the model cannot tell from a space. Repeated rows and null ids as in ``common``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spreadrank.llm.bytes_np import BASE, BYTE, STEP, U, grouped, mix, pieces, powers, texts
from spreadrank.llm.common import drop_tables, materialize, one_row_per_doc, release
from spreadrank.llm.word_table import hot_count

SPACE = "▁"
#: A word is a run of spaces with what follows, or a new line (``_spans`` finds them).
WORDS = r" *[^ \n]+| +|\n"
#: Words in a trie (the fold copies its state for each node, so that tries are small); longer words than WIDE characters are blocks of their own.
BLOCK, WIDE = 16, 64
#: The most words that are sent to every task, of HOT_BYTES each at most.
HOT, HOT_BYTES = 1 << 19, 64
#: Parts of the documents whose seldom words are looked up one after the other, so that a part of their shuffles is on disk at a time.
PARTS = 2
#: What a Python worker has at hand at once, so that it stays small: bytes of text, words of a lattice, words put together.
RUN, TRIES, CHUNK = 1 << 18, 120 * BLOCK, 50_000
#: Bytes of text in which words are counted before they are summed up, and the most words that a task holds for that.
COUNTED, HELD = 1 << 19, 1 << 19


@dataclass
class Model:
    """A vocabulary: (piece, score, id). byte_ids: id of byte 0, the others follow it."""

    pieces: list[tuple[str, float, int]]
    byte_ids: int | None
    unknown: int

    @property
    def unknown_score(self) -> float:
        return min(s for _, s, _ in self.pieces) - 10


def load_model(path: str) -> Model:
    """The vocabulary of a SentencePiece model file (read on the driver; its size doesn't depend on the data)."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(sp.get_piece_size())
    plain = [i for i in ids if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    found = [(sp.id_to_piece(i), sp.get_score(i), i) for i in plain]
    if any("\n" in p or SPACE in p.lstrip(SPACE) for p, *_ in found):
        raise ValueError("this model has pieces across words")
    return Model(found, next((i for i in ids if sp.is_byte(i)), None), sp.unk_id())


def escaped(text: Column) -> Column:
    """A text with its leading space; empty and null stay."""
    return F.when(text == "", text).otherwise(F.concat(F.lit(" "), F.replace(text, F.lit(SPACE), F.lit(" "))))


def words_of(texts: DataFrame) -> DataFrame:
    """(word, n): the different words of escaped texts and their occurrences.

    Tasks have summed their words up, so they are dealt before Spark's aggregate, which would find next to nothing to sum up before.
    """
    return texts.select("text").mapInArrow(_counted, "word string, n long").repartition("word").groupBy("word").agg(F.sum("n").alias("n"))


def _counted(batches: Iterator[pa.RecordBatch], limit: int = HELD) -> Iterator[pa.RecordBatch]:
    """(word, n) of runs of texts, summed up while there are no more than ``limit`` rows; words with the same hash are the same."""
    held, rows = [], 0
    for batch in batches:
        for _, _, data, offsets in pieces(batch.column(0), COUNTED):
            if not len(data):
                continue
            starts, ends = _spans(data, offsets)
            hashes = _hashes(data, starts, ends)
            order, heads = grouped(hashes)
            at = order[heads]
            held.append((hashes[at], np.diff(heads, append=len(order)), _words(data, starts[at], (ends - starts)[at])))
            rows += len(at)
            if rows > limit:
                held = [_summed(held)]
                rows = len(held[0][0])
                if rows > limit // 2:
                    yield _table(held.pop())
                    rows = 0
    if held:
        yield _table(_summed(held))


def _words(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    cuts = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(cuts), pa.py_buffer(_gathered(data, starts, sizes))])


def _summed(held: list[tuple[np.ndarray, np.ndarray, pa.Array]]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(hash, n, word) of several such tables, their counts summed up."""
    hashes, n = (np.concatenate([x[i] for x in held]) for i in (0, 1))
    order, heads = grouped(hashes)
    at = order[heads]
    return hashes[at], np.add.reduceat(n[order], heads), pa.concat_arrays([w for *_, w in held]).take(pa.array(at))


def _table(summed: tuple[np.ndarray, np.ndarray, pa.Array]) -> pa.RecordBatch:
    _, n, words = summed
    return pa.RecordBatch.from_arrays([words.cast(pa.binary()).cast(pa.string()), pa.array(n)], names=["word", "n"])


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points, lengths), a row for each word."""
    n = np.array([len(w) for w in words])
    c = np.zeros((len(words), n.max()), np.uint32)
    c[np.arange(c.shape[1]) < n[:, None]] = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    return c, n


def _sums(c: np.ndarray) -> np.ndarray:
    """Sums of the hashes of code points along the rows, so that any substring's hash is a difference."""
    with np.errstate(over="ignore"):
        out = np.zeros((len(c), c.shape[1] + 1), np.uint64)
        np.cumsum(mix((c.astype(np.uint64) + U(1)) * STEP) * powers(BASE, c.shape[1])[: c.shape[1]], axis=1, out=out[:, 1:])
    return out


EDGES = "words array<string>, n array<long>, last array<int>, nodes array<array<struct<score:double,origin:int,id:int>>>"


class Pieces:
    """The piece table by length, hashes sorted for joins."""

    def __init__(self, model: Model):
        self.byte_ids, self.unknown, self.unknown_score = model.byte_ids, model.unknown, model.unknown_score
        self.scores = np.zeros(max(i for *_, i in model.pieces) + 1)
        by_length: dict[int, dict[str, int]] = {}
        for piece, score, i in model.pieces:
            by_length.setdefault(len(piece), {}).setdefault(piece.replace(SPACE, " "), i)
            self.scores[i] = score
        self.tables = {}
        for k, own in sorted(by_length.items()):
            hashes, ids = mix(_sums(_codes(list(own))[0])[:, -1]), np.array(list(own.values()), np.int32)
            order = np.argsort(hashes)
            self.tables[k] = (hashes[order], ids[order])
        self.longest = max(self.tables)

    def block_rows(self, words: list[str], n: pa.Array) -> pa.RecordBatch:
        """The lattice of sorted words, a row for each BLOCK of them, see EDGES."""
        c, size = _codes(words)
        places = np.arange(c.shape[1])
        inside = places < size[:, None]
        shared = np.zeros(len(words), np.int64)
        shared[1:] = np.cumprod((c[1:] == c[:-1]) & inside[1:] & inside[:-1], axis=1).sum(1)
        shared[::BLOCK] = 0
        row, at = np.nonzero(inside & (places >= shared[:, None]))  # a node is the prefix of row's word that ends at place ``at``
        number = np.zeros((len(words), c.shape[1] + 1), np.int64)
        number[row, at + 1] = np.arange(1, len(row) + 1)
        number = np.maximum.accumulate(number, axis=0)  # a prefix that is shared has the number of the word before
        before = number[::BLOCK, 1] - 1  # nodes before each block
        base = before[np.arange(len(words)) // BLOCK]
        sums, inverse = _sums(c), powers(pow(BASE, -1, 1 << 64), c.shape[1])
        ids = np.full((len(row), self.longest), -1, np.int32)
        with np.errstate(over="ignore"):
            for k, (hashes, own) in self.tables.items():
                node = np.flatnonzero(at >= k - 1)
                r, e = row[node], at[node] + 1
                h = mix((sums[r, e] - sums[r, e - k]) * inverse[e - k])
                found = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                hit = hashes[found] == h
                ids[node[hit], k - 1] = own[found[hit]]
        ids[:, 0] = np.where(ids[:, 0] < 0, -2 - c[row, at].astype(np.int64), ids[:, 0])  # no piece: the character itself
        edge = ids != -1
        node, k = np.nonzero(edge)
        i, start = ids[node, k], at[node] - k
        origin = np.where(start > 0, number[row[node], start] - base[row[node]], 0)
        edges = pa.StructArray.from_arrays([pa.array(np.where(i >= 0, self.scores[np.maximum(i, 0)], self.unknown_score)), pa.array(origin.astype(np.int32)), pa.array(i)], names=["score", "origin", "id"])
        each = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(edge.sum(1)))).astype(np.int32), edges)
        cuts = np.append(np.arange(0, len(words), BLOCK), len(words)).astype(np.int32)
        last = pa.array((number[np.arange(len(words)), size] - base).astype(np.int32))
        columns = [pa.ListArray.from_arrays(cuts, x) for x in (pa.array(words), n, last)]
        return pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(np.append(before, len(row)).astype(np.int32), each)], names=["words", "n", "last", "nodes"])

    def lattice(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word, n = batch.column(0), batch.column(1)
            wide = np.array(pc.utf8_length(word)) > WIDE
            for i in np.flatnonzero(wide):
                yield self.block_rows([word[i].as_py()], n.slice(i, 1))
            short = pa.array(~wide)
            word, n = word.filter(short), n.filter(short)
            for first in range(0, len(word), TRIES):
                yield self.block_rows(word.slice(first, TRIES).to_pylist(), n.slice(first, TRIES))

    def read_back(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(key, bytes, n, ids) from blocks with the best edge of every node: each word's hash, as texts have it, and length."""
        step = TRIES // BLOCK
        for batch in (whole.slice(first, step) for whole in batches for first in range(0, whole.num_rows, step)):
            words, n, last, origin, ids = (batch.column(i) for i in range(5))
            base = np.repeat(origin.offsets.to_numpy()[:-1] - origin.offsets[0].as_py(), np.diff(words.offsets.to_numpy()))
            words, n = words.flatten(), n.flatten()
            origin, ids, at = -origin.flatten().to_numpy(), ids.flatten().to_numpy(), last.flatten().to_numpy().copy()
            live, owners, found = np.arange(len(at)), [], []
            while len(live):
                node = base[live] + at[live]
                owners.append(live)
                found.append(ids[node])
                at[live] = origin[node]
                live = live[at[live] > 0]
            if not owners:
                continue
            owner, token = np.concatenate(owners[::-1]), np.concatenate(found[::-1])
            order = np.argsort(owner, kind="stable")
            owner, token = self.whole(owner[order], token[order])
            offsets = np.searchsorted(owner, np.arange(len(at) + 1)).astype(np.int32)
            data, ends = texts(words)
            key, size = pa.array(_hashes(data, ends[:-1], ends[1:]).view(np.int64)), pa.array(np.diff(ends).astype(np.int32))
            yield pa.RecordBatch.from_arrays([key, size, n, pa.ListArray.from_arrays(offsets, pa.array(token))], names=["key", "bytes", "n", "ids"])

    def whole(self, owner: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece (-2 - code point) as ids of their bytes, or as the unknown id."""
        other = np.flatnonzero(token < 0)
        if not len(other):
            return owner, token
        if self.byte_ids is None:
            return owner, np.where(token < 0, np.int32(self.unknown), token)
        raw = [chr(-2 - t).encode() for t in token[other].tolist()]
        size = np.ones(len(token), np.int64)
        size[other] = [len(x) for x in raw]
        out = np.repeat(token, size)
        out[out < 0] = np.frombuffer(b"".join(raw), np.uint8).astype(np.int32) + self.byte_ids
        return np.repeat(owner, size), out


def viterbi(nodes: Column) -> Column:
    """For each node (0 is the empty prefix): the best sum of scores, minus the node it came from, and the id of the last piece."""
    first = F.array(F.struct(F.lit(0.0).alias("v"), F.lit(0).alias("origin"), F.lit(0).alias("id")))

    def step(best: Column, edges: Column) -> Column:
        ways = F.transform(edges, lambda e: F.struct((F.get(best, e["origin"])["v"] + e["score"]).alias("v"), (-e["origin"]).alias("origin"), e["id"].alias("id")))
        return F.concat(best, F.array(F.array_max(ways)))

    return F.aggregate(nodes, first, step)


def encode_words(words: DataFrame, model: Model) -> DataFrame:
    """(key, bytes, n, ids) for a table (word, n) of different words.

    The best paths are dealt anew before they are read back: a stage with two passes in Python has twice as many workers.
    """
    table = Pieces(model)
    blocks = words.select("word", "n").sortWithinPartitions("word").mapInArrow(table.lattice, EDGES)
    best = blocks.select("words", "n", "last", viterbi(F.col("nodes")).alias("path")).select("words", "n", "last", "path.origin", "path.id")
    return best.repartition(F.col("words")[0]).mapInArrow(table.read_back, "key long, bytes int, n long, ids array<int>")


def _spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the words of escaped texts, by the rule of WORDS."""
    line, space, head = data == 10, data == 32, np.zeros(len(data) + 1, bool)
    head[offsets] = True
    starts = line | head[:-1] | space
    starts[1:] = head[1:-1] | line[1:] | line[:-1] | space[1:] & ~space[:-1]
    at = np.flatnonzero(starts)
    return at, np.append(at[1:], len(data))


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE[data] * powers(BASE, len(data))[: len(data)], dtype=np.uint64, out=sums[1:])
        return mix((sums[ends] - sums[starts]) * powers(pow(BASE, -1, 1 << 64), len(data))[starts] + (ends - starts).astype(np.uint64) * STEP)


class Frequent:
    """The words sent to every task: sorted hashes, each word's number (by falling count) and the ids of each number."""

    def __init__(self, table: pa.Table):
        pools = [np.zeros(0, np.int32), *(narrow(chunk.flatten().to_numpy()) for chunk in table["ids"].chunks)]
        whole, sizes = table["key"].to_numpy().view(np.uint64), np.array(pc.list_value_length(table["ids"]), np.int64)
        order = np.argsort(-table["n"].to_numpy(), kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        by_hash = np.argsort(whole)
        self.hashes, self.numbers, self.ids = whole[by_hash], rank[by_hash], narrow(np.concatenate(pools))
        self.shift = U(64 - max(1, len(whole).bit_length()))
        heads = np.searchsorted(self.hashes >> self.shift, np.arange(1 << (64 - int(self.shift)), dtype=np.uint64))
        self.heads = np.append(heads, len(whole)).astype(np.int32)  # where the hashes with the same first bits begin
        self.sizes, self.starts = narrow(sizes[order]), narrow((np.cumsum(sizes) - sizes)[order])

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Each word's number, -1 for other words."""
        out, head = np.full(len(hashes), -1, np.int32), (hashes >> self.shift).astype(np.int64)
        at, end = self.heads[head], self.heads[head + 1]
        live = np.flatnonzero(at < end)
        at = at[live]
        while len(live):
            same = self.hashes[at] == hashes[live]
            out[live[same]] = self.numbers[at[same]]
            more = ~same & (at + 1 < end[live])
            live, at = live[more], at[more] + 1
        return out


def narrow(x: np.ndarray) -> np.ndarray:
    """Numbers from 0 in the smallest type that holds them."""
    return x.astype(np.min_scalar_type(int(x.max()))) if len(x) else x


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers as a small blob: their low bytes first."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress((numbers + 1).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpacked(blob: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64) - 1


def _numbered(sent, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first, last, words' hashes and numbers, cuts between texts) of runs of escaped texts."""
    for first, last, data, offsets in pieces(texts, RUN):
        starts, ends = _spans(data, offsets) if len(data) else (np.zeros(0, np.int64),) * 2
        hashes = _hashes(data, starts, ends)
        yield first, last, hashes, sent.value.find(hashes), np.searchsorted(starts, offsets)


def seldom(sent):
    """mapInArrow function: (text, doc_id) to (doc_id, place, key) for each word without a number; places count these from 0 in each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, hashes, numbers, cuts in _numbered(sent, batch.column(0)):
                at = np.flatnonzero(numbers < 0)
                before = np.searchsorted(at, cuts)
                owner = np.repeat(np.arange(last - first), np.diff(before))
                place = pa.array((np.arange(len(at)) - before[owner]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(first, last - first).take(pa.array(owner)), place, pa.array(hashes[at].view(np.int64))], names=["doc_id", "place", "key"])

    return run


def numbered(sent):
    """mapInArrow function: (text, other columns) to (packed numbers, other columns)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, _, numbers, cuts in _numbered(sent, batch.column(0)):
                part = batch.slice(first, last - first)
                packed = [_packed(numbers[a:z]) if ok else None for a, z, ok in zip(cuts[:-1], cuts[1:], part.column(0).is_valid().to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary()), *part.columns[1:]], names=["numbers", *part.schema.names[1:]])

    return run


def _gathered(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """pool[start : start + size] of all, one after the other."""
    ends = np.cumsum(sizes)
    return pool[np.repeat(starts - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]


def put_together(sent):
    """mapInArrow function: (numbers, rest: array of (place, ids), other columns) to (ids, other columns)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, words = [], 0
            for i in range(batch.num_rows):
                blob = batch.column(0)[i].as_py()
                held.append(_unpacked(blob) if blob is not None else None)
                words += len(held[-1]) if blob is not None else 0
                if words >= CHUNK or i == batch.num_rows - 1:
                    yield whole(batch.slice(i + 1 - len(held), len(held)), held)
                    held, words = [], 0

    def whole(part: pa.RecordBatch, held: list) -> pa.RecordBatch:
        own = sent.value
        sizes = np.array([0 if x is None else len(x) for x in held])
        numbers = np.concatenate([x for x in held if x is not None] or [np.zeros(0, np.int64)])
        rest = part.column(1).fill_null([]) if part.column(1).null_count else part.column(1)
        places = rest.flatten()
        order = np.lexsort((places.field("place").to_numpy(), np.repeat(np.arange(len(held)), np.array(pc.list_value_length(rest)))))
        ids = places.field("ids")
        from_, to = ids.offsets.to_numpy()[:-1].astype(np.int64)[order], ids.offsets.to_numpy()[1:].astype(np.int64)[order]
        known, at = numbers >= 0, np.maximum(numbers, 0)
        starts, lengths = np.zeros(len(numbers), np.int64), np.zeros(len(numbers), np.int64)
        if len(own.hashes):
            starts, lengths = own.starts[at].astype(np.int64), own.sizes[at].astype(np.int64)
        starts[~known], lengths[~known] = from_ + len(own.ids), to - from_
        out = _gathered(np.concatenate((own.ids, ids.values.to_numpy())), starts, lengths)
        cuts = np.concatenate(([0], np.cumsum(lengths)))[np.concatenate(([0], np.cumsum(sizes)))]
        lists = pa.ListArray.from_arrays(cuts.astype(np.int32), pa.array(out.astype(np.int32)), mask=pa.array([x is None for x in held]))
        return pa.RecordBatch.from_arrays([lists, *part.columns[2:]], names=["ids", *part.schema.names[2:]])

    return run


def encode(docs: DataFrame, model: Model, hot: int = HOT) -> DataFrame:
    """(doc_id, ids array<int>) of every whole text; null texts have null."""
    texts = one_row_per_doc(docs, columns=["text"])
    return encode_texts(texts.select(escaped(F.col("text")).alias("text"), "doc_id"), model, hot=hot).select("doc_id", "ids")


def _columns(fields) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)


def encode_texts(texts: DataFrame, model: Model, hot: int = HOT, text: bool = False) -> DataFrame:
    """(ids, doc_id and other columns) from (escaped text, doc_id and other columns), and on demand the decoded text.

    Ids are made last and never shuffled: texts move as numbers, two bytes a word or so.
    """
    spark = texts.sparkSession
    others = texts.schema[1:]
    release(spark)  # what the operators before have left on the driver
    table = materialize(encode_words(words_of(texts), model), "word-ids")
    release(spark)
    often = (F.col("n") >= hot_count(table, hot=hot)) & (F.col("bytes") <= HOT_BYTES)
    sent = spark.sparkContext.broadcast(Frequent(table.filter(often).select("key", "n", "ids").toArrow()))
    parts = []
    for part in range(PARTS):
        own = texts.filter(F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)) == part)
        asked = own.select("text", "doc_id").mapInArrow(seldom(sent), f"{_columns([texts.schema['doc_id']])}, place int, key long")
        found = asked.join(table.filter(~often).select("key", "ids"), "key").groupBy("doc_id").agg(F.collect_list(F.struct("place", "ids")).alias("rest"))
        parts.append(materialize(found, f"seldom-ids-{part}"))
        release(spark)
    drop_tables(table)
    rest = reduce(DataFrame.unionByName, parts)
    numbers = texts.mapInArrow(numbered(sent), f"numbers binary, {_columns(others)}")
    both = numbers.join(rest, "doc_id", "left").select("numbers", "rest", *[f.name for f in others])
    whole, names = put_together(sent), f"ids array<int>, {_columns(others)}"
    if not text:
        return both.mapInArrow(whole, names)
    back = Bytes(model).decoded
    return both.mapInArrow(lambda batches: back(whole(batches)), f"{names}, decoded binary").withColumn("decoded", valid(F.col("decoded")))


class Bytes:
    """The bytes of every id; ids without a piece have none."""

    def __init__(self, model: Model):
        raw = {i: p.replace(SPACE, " ").encode() for p, _, i in model.pieces}
        if model.byte_ids is not None:
            raw |= {model.byte_ids + b: bytes([b]) for b in range(256)}
        parts = [raw.get(i, b"") for i in range(max(raw) + 2)]
        self.pool = np.frombuffer(b"".join(parts), np.uint8)
        self.sizes = np.array([len(p) for p in parts])
        self.starts = np.cumsum(self.sizes) - self.sizes

    def decoded(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches (ids, other columns) with the texts as a last column."""
        for batch in batches:
            step = max(1, CHUNK * 4 * batch.num_rows // max(1, len(batch.column(0).values)))
            for first in range(0, batch.num_rows, step):
                part = batch.slice(first, step)
                ids = part.column(0).flatten().to_numpy()
                ids = np.where((ids >= 0) & (ids < len(self.sizes)), ids, len(self.sizes) - 1)
                out = _gathered(self.pool, self.starts[ids], self.sizes[ids])
                counts = np.array(pc.fill_null(pc.list_value_length(part.column(0)), 0), np.int64)
                cuts = np.concatenate(([0], np.cumsum(self.sizes[ids])))[np.concatenate(([0], np.cumsum(counts)))]
                starts, raw = cuts[:-1], out.tobytes()
                texts = [raw[a + (raw[a : a + 1] == b" ") * (a < z) : z] if ok else None for a, z, ok in zip(starts.tolist(), cuts[1:].tolist(), part.column(0).is_valid().to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary())], names=[*part.schema.names, "decoded"])


def valid(raw: Column) -> Column:
    return F.make_valid_utf8(raw.cast("string"))


def decode(encoded: DataFrame, model: Model) -> DataFrame:
    """(doc_id, text) from (doc_id, ids): the bytes of the ids in order, without the leading space."""
    rows = encoded.select("ids", "doc_id")
    return rows.mapInArrow(Bytes(model).decoded, f"{_columns(rows.schema)}, decoded binary").select("doc_id", valid(F.col("decoded")).alias("text"))


def round_trips(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_chars, ids, n_tokens, round_trip) of each text, encoded whole and decoded again.

    round_trip: the decoded text is the text (with a space for ``▁``); null texts have null.
    """
    sha = lambda c: F.unhex(F.sha2(F.encode(c, "UTF-8"), 256))
    docs = one_row_per_doc(docs, columns=["text"])
    texts = docs.select(escaped(F.col("text")).alias("text"), "doc_id", F.length("text").cast("long").alias("n_chars"), sha(F.replace("text", F.lit(SPACE), F.lit(" "))).alias("sha"))
    n = F.coalesce(F.when(F.col("ids").isNotNull(), F.size("ids")), F.lit(0)).cast("long")
    return encode_texts(texts, model, text=True).select("doc_id", "n_chars", "ids", n.alias("n_tokens"), (F.col("sha") == sha(F.col("decoded"))).alias("round_trip"))
