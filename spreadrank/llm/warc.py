"""WARC archives: write pages as records with revisits, read them back, and merge their sorted indexes.

Writing is Spark's own text sink with ``\\r\\n\\r\\n`` as separator, which is what ends a WARC record, so files reach any store
by its commit protocol. Each file is one gzip stream; records are told apart by Content-Length, never by the separator.

Of records with equal payloads of at least ``min_revisit`` bytes, the one with the largest id is the response and the others
are revisits that refer to it and carry the HTTP head only. Equal payloads are told by SHA-1 and length.

Reading gives each file's records, and its index as a run sorted by (URL key, time, id). ``merge_runs`` deals runs out by
range of that whole key, so captures of one URL spread over tasks, and merges the pieces of each range with a loser tree.

Nulls: a null payload is empty, a null URL has no header and the key ``''``, a null time no WARC-Date (it sorts first). Rows
without id are dropped; repeated ids count once (see ``common``). An empty table gives an archive without records.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spreadrank.llm.common import materialize, one_row_per_doc

END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id long, url string, ts timestamp, record_type string, refers_to long, payload_bytes long, payload_digest string, intact boolean, run string, seq long, url_key string"


def url_key(url: str | None) -> str:
    """Labels of the host from the right, joined by commas, then ``)`` and path with query: ``com,example)/a?b``."""
    m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^#]*)", url or "", re.S)
    if not m:
        return url or ""
    host = re.sub(r":\d*$", "", m[1].rpartition("@")[2].lower())
    return ",".join(reversed(host.removeprefix("www.").split("."))) + ")" + (m[2] or "/")


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", time_col: str = "ts", min_revisit: int = 1000, records_per_file: int = 4000) -> None:
    """Write a record for each page to gzip files in the folder ``path``."""
    df = one_row_per_doc(pages, id_col, [url_col, payload_col, time_col]).select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("body"), F.col(time_col).alias("ts"))
    sums = df.select("id", F.sha1(F.encode("body", "UTF-8")).alias("digest"), F.octet_length("body").alias("size")).filter(F.col("size") >= min_revisit)
    last = sums.groupBy("digest", "size").agg(F.max("id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    revisits = sums.join(last, ["digest", "size"]).filter("id < refers_to").select("id", "refers_to")
    df = df.join(revisits, "id", "left")
    again = F.col("refers_to").isNotNull()
    size = F.octet_length("body").cast("string")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size, F.lit(END))
    clean = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.col("id").cast("string"), F.lit(">"))),
        F.coalesce(line("WARC-Target-URI", clean), F.lit("")),
        F.coalesce(line("WARC-Date", _utc(F.col("ts"))), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.sha1(F.encode("body", "UTF-8")))),
        F.when(again, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))))).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
    )
    block = F.concat(http, F.when(again, "").otherwise(F.col("body")))
    record = F.concat(head, line("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"), block)
    df.select(record.alias("value")).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def _utc(ts: Column) -> Column:
    """The time in UTC, whatever the session's time zone."""
    micros = F.unix_micros(ts)
    day = F.floor(micros / F.lit(86_400_000_000)).cast("long")
    rest = micros - day * 86_400_000_000
    two = lambda x: F.lpad(F.floor(x).cast("string"), 2, "0")
    clock = F.concat(two(rest / 3_600_000_000), F.lit(":"), two(rest / 60_000_000 % 60), F.lit(":"), two(rest / 1_000_000 % 60), F.lit("."), F.lpad((rest % 1_000_000).cast("string"), 6, "0"), F.lit("Z"))
    return F.concat(F.date_from_unix_date(day.cast("int")).cast("string"), F.lit("T"), clock)


def parse_records(stream) -> Iterator[tuple[dict, bytes]]:
    """(headers, block) of each record of an open, decompressed WARC file, by Content-Length."""
    while first := stream.readline():
        if first in (b"\r\n", b"\n"):
            continue
        if not first.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at {first[:40]!r}")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode("utf-8").rstrip("\r\n").partition(": ")
            headers[name.lower()] = value
        block = stream.read(int(headers["content-length"]))
        if len(block) < int(headers["content-length"]):
            raise ValueError("a WARC record is cut short")
        yield headers, block


def _index_rows(name: str, content: bytes) -> list[tuple]:
    import datetime as dt

    number = lambda x: int(x.rpartition(":")[2].rstrip(">")) if x else None
    rows = []
    for h, block in parse_records(io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content)), 1 << 20)):
        http, _, payload = block.partition(b"\r\n\r\n")
        size = int(re.search(rb"Content-Length: (\d+)", http)[1])
        digest = h["warc-payload-digest"].removeprefix("sha1:")
        again = h["warc-type"] == "revisit"
        ts = dt.datetime.fromisoformat(h["warc-date"]) if "warc-date" in h else None
        intact = again and not payload or len(payload) == size and hashlib.sha1(payload).hexdigest() == digest
        url = h.get("warc-target-uri")
        rows.append((number(h["warc-record-id"]), url, ts, h["warc-type"], number(h.get("warc-refers-to")), size, digest, intact, name, url_key(url)))
    rows.sort(key=run_order)
    return rows


def run_order(r: tuple) -> tuple:
    return r[9].encode(), r[2] is not None, r[2].timestamp() if r[2] else 0.0, r[0]


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Index of the archives in ``path``: a sorted run for each file (``run``, ``seq``); ``intact`` says that the payload has its digest."""

    def runs(batches):
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                name = name.as_py().rpartition("/")[2]
                rows = _index_rows(name, content.as_py())
                cols = list(zip(*rows, strict=True)) if rows else [[] for _ in range(10)]
                types = [pa.int64(), pa.string(), pa.timestamp("us", "UTC"), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string()]
                arrays = [pa.array(c, t) for c, t in zip(cols, types, strict=False)] + [pa.array(range(len(rows)), pa.int64()), pa.array(cols[9], pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=["page_id", "url", "ts", "record_type", "refers_to", "payload_bytes", "payload_digest", "intact", "run", "seq", "url_key"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")
    return files.mapInArrow(runs, RECORD)


class LoserTree:
    """Merges sorted sequences: each inner node keeps the loser of its match, so a step costs one match a level."""

    def __init__(self, runs: list[list], key):
        self.runs, self.key, self.k = runs, key, len(runs)
        self.at = [0] * self.k
        self.heads = [key(r[0]) if r else None for r in runs]
        self.tree = [-1] * max(1, self.k)
        for leaf in range(self.k):
            self._play_in(leaf)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None if x is None or y is None else (x, a) < (y, b)

    def _play_in(self, leaf: int) -> None:
        node, winner = (leaf + self.k) // 2, leaf
        while node > 0:
            if self.tree[node] < 0:
                self.tree[node] = winner
                return
            if self._beats(self.tree[node], winner):
                self.tree[node], winner = winner, self.tree[node]
            node //= 2
        self.tree[0] = winner

    def __iter__(self):
        while self.k:
            winner = self.tree[0]
            if self.heads[winner] is None:
                return
            yield self.runs[winner][self.at[winner]]
            self.at[winner] += 1
            run, i = self.runs[winner], self.at[winner]
            self.heads[winner] = self.key(run[i]) if i < len(run) else None
            node = (winner + self.k) // 2
            while node > 0:
                if self._beats(self.tree[node], winner):
                    self.tree[node], winner = winner, self.tree[node]
                node //= 2
            self.tree[0] = winner


def merge_runs(index: DataFrame, rows_per_task: int = 100_000) -> DataFrame:
    """read_warc()'s runs merged into one order by (url_key, ts, page_id), with order_no from 0."""
    index = materialize(index, "warc-runs")
    tasks = max(1, -(-index.count() // rows_per_task))

    def merged(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        table = [b for b in batches if b.num_rows]
        if not table:
            return
        whole = pa.Table.from_batches(table)
        times = whole["ts"].cast(pa.int64()).to_pylist()
        keys = [(u, t is not None, t or 0, p) for u, t, p in zip(whole["url_key"].cast(pa.binary()).to_pylist(), times, whole["page_id"].to_pylist(), strict=True)]
        runs: dict[str, list[tuple[int, int]]] = {}
        for i, (run, seq) in enumerate(zip(whole["run"].to_pylist(), whole["seq"].to_pylist(), strict=True)):
            runs.setdefault(run, []).append((seq, i))
        pieces = [sorted(v) for _, v in sorted(runs.items())]
        order = [i for _, i in LoserTree(pieces, lambda x: keys[x[1]])]
        whole = whole.take(pa.array(order, pa.int64()))
        whole = whole.append_column("part", pa.array([part] * len(order), pa.int32())).append_column("pos", pa.array(range(len(order)), pa.int64()))
        yield from whole.to_batches(10_000)

    dealt = index.repartitionByRange(tasks, "url_key", "ts", "page_id")
    out = materialize(dealt.mapInArrow(merged, RECORD + ", part int, pos long"), "warc-merged")
    counts = out.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return out.join(F.broadcast(before), "part").withColumn("order_no", F.col("pos") + F.col("before")).drop("part", "pos", "before")
