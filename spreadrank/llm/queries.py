"""The registered queries of this subpackage: (SparkSession, folder) -> DataFrame, and their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spreadrank.llm.common import lower_ascii, new_path, one_row_per_doc
from spreadrank.llm.decontaminate import find_leaks
from spreadrank.llm.jaccard_join import jaccard_classes
from spreadrank.llm.kneser_ney import classify
from spreadrank.llm.line_dedup import dedup_lines
from spreadrank.llm.pii import replace_pii
from spreadrank.llm.quality_rules import quality_rules
from spreadrank.llm.sentencepiece_lattice import load_model, round_trips
from spreadrank.llm.sharding import ShardStore
from spreadrank.llm.suffix_repeats import remove_repeats
from spreadrank.llm.warc import merge_runs, read_warc, write_warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sha256(text) -> F.Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


OP1 = r"""
with d as (select doc_id, coalesce(source, chr(1)) host, coalesce(text, '') text from documents),
w as (select *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) ls from d),
g as (select doc_id, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] g from (select doc_id, w, unnest(generate_series(1, len(w) - 2)) i from w where len(w) > 2)),
r as (select doc_id, count(distinct i + k) n from (select doc_id, i, count(*) over (partition by doc_id, g) c from g), generate_series(0, 2) t(k) where c > 1 group by 1),
l as (select doc_id, host, trim(regexp_replace(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g')) t from (select doc_id, host, unnest(ls) x from w)),
f as (select host, t from (select host, t, count(distinct doc_id) n from l group by 1, 2) join (select host, count(*) m from d group by 1) using (host) where n > 20 and n > m * 0.01::double),
x as (select doc_id, count(*) n, sum(len(string_split(t, ' '))) gone from l join f using (host, t) group by 1),
b as (select w.doc_id, len(w.w)::bigint n_words, length(translate(w.text, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13), ''))::bigint word_chars, (length(w.text) - length(translate(w.text, '#*$%&|<>', '')))::bigint n_symbols,
  (len(ls) - len(list_distinct(ls)))::bigint n_dup_lines, coalesce(r.n, 0)::bigint n_repeat_words, coalesce(x.n, 0)::bigint n_removed_lines, (len(w.w) - coalesce(gone, 0))::bigint n_left_words from w left join r using (doc_id) left join x using (doc_id))
select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words base_failed, not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and n_left_words >= 0.3::double * n_words kept from b
"""


def op2_warc_index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html", F.timestamp_seconds(F.col("page_id") % 86400 + 1704067200).alias("ts"))
    path = new_path(spark, "warc")
    write_warc(pages, path)
    return merge_runs(read_warc(spark, path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "order_no")


OP2 = r"""
with p as (select page_id, url, coalesce(html, '') h, page_id % 86400 ts, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^#]*)', ['host', 'rest']) m from pages),
q as (select page_id, strlen(h) b, sha1(h) d, ts, case when m.host = '' then coalesce(url, '') else list_aggregate(list_reverse(string_split(regexp_replace(regexp_replace(lower(m.host), ':[0-9]*$', ''), '^www\.', ''), '.')), 'string_agg', ',') || ')' || case when m.rest = '' then '/' else m.rest end end url_key from p),
r as (select *, max(page_id) over (partition by d, b) last from q)
select page_id, b::bigint payload_bytes, d payload_digest, case when b >= 1000 and page_id < last then 'revisit' else 'response' end record_type, case when b >= 1000 and page_id < last then last end refers_to, url_key, row_number() over (order by url_key collate "binary", ts, page_id) - 1 order_no from r
"""


#: The vocabulary file of op3; a parameter of the query.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def op3_sentencepiece(spark: SparkSession, sf_dir: str, model_file: str = PIECES) -> DataFrame:
    return round_trips(table(spark, sf_dir, "documents"), load_model(model_file))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return leaks.select("doc_id", "items", F.round("coverage", 9).alias("coverage"), (F.size("items") > 0).alias("contaminated"))


def op5_line_dedup(spark: SparkSession, sf_dir: str, long: int | None = None) -> DataFrame:
    """Windows of two lines only, as in its SQL."""
    df = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), long=long)
    return df.select("doc_id", "n_lines", "n_removed", "n_runs", F.length("text").cast("long").alias("n_chars_left"), sha256("text").alias("kept_sha256"))


def op5_line_dedup_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single lines of over 50 words too, as in the pipeline."""
    return op5_line_dedup(spark, sf_dir, long=50)


OP5 = r"""
with l as (select doc_id, i, x, trim(x, chr(32)||chr(9)||chr(11)||chr(12)||chr(13)) t from (select doc_id, unnest(string_split(text, chr(10))) x, generate_subscripts(string_split(text, chr(10)), 1) i from documents)),
f as (select *, row_number() over (partition by doc_id order by i) - 1 k from l where t <> ''),
g as (select a.doc_id, a.k, a.t || chr(10) || b.t g from f a join f b on a.doc_id = b.doc_id and b.k = a.k + 1),
s as (select doc_id, k from (select doc_id, k, row_number() over (partition by g order by doc_id, k) r from g) where r > 1),
gone as (select distinct doc_id, k + o k from s, generate_series(0, 1) t(o)),
runs as (select doc_id, count(*) n from (select doc_id, k, lag(k) over (partition by doc_id order by k) p from s) where p is null or k > p + 2 group by 1),
r as (select l.doc_id, count(*) n_lines, count(gone.k) n_removed, string_agg(l.x, chr(10) order by l.i) filter (gone.k is null) t from l left join f on f.doc_id = l.doc_id and f.i = l.i left join gone on gone.doc_id = f.doc_id and gone.k = f.k group by 1)
select d.doc_id, coalesce(n_lines, 0)::bigint n_lines, coalesce(n_removed, 0)::bigint n_removed, coalesce(runs.n, 0)::bigint n_runs, case when text is not null then length(coalesce(t, ''))::bigint end n_chars_left, case when text is not null then sha256(coalesce(t, '')) end kept_sha256
from documents d left join r using (doc_id) left join runs using (doc_id)
"""


def op6_sharding(spark: SparkSession, sf_dir: str, arrivals: int = 8) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    store = ShardStore(spark, new_path(spark, "shards"))
    step = ((high or 0) - (low or 0)) // arrivals + 1
    for i in range(arrivals):
        batch = (F.col("doc_id") >= (low or 0) + i * step) & (F.col("doc_id") < (low or 0) + (i + 1) * step)
        store.append(docs.filter(batch | F.col("doc_id").isNull() if i == 0 else batch))
        store.compact()
        store.vacuum()
    return store.read().select("doc_id", "source", F.octet_length("text").cast("long").alias("n_bytes"), sha256("text").alias("text_sha256"))


OP6 = "select doc_id, source, strlen(text)::bigint n_bytes, sha256(text) text_sha256 from documents"

def op7_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return df.select("doc_id", "lang", "n_scored", *[F.round(c, 6).alias(c) for c in ("log_ppl", "threshold", "worst", "worst_threshold")], "kept")


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda a, x: a + x)
    return df.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = replace_pii(table(spark, sf_dir, "documents").select("doc_id", "text"), key="surrogates of documents")
    return df.select("doc_id", "n_entities", "entity_types", "text")


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"), n=3, percent=90)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_pipeline import run  # it imports this module

    return run(spark, sf_dir)


QUERIES = {"op1_quality_rules": op1_quality_rules, "op2_warc_index_merge": op2_warc_index_merge, "op3_sentencepiece": op3_sentencepiece, "op4_benchmark_decontamination": op4_benchmark_decontamination, "op5_line_dedup": op5_line_dedup, "op5_line_dedup_long": op5_line_dedup_long, "op6_sharding": op6_sharding, "op7_kneser_ney_quality": op7_kneser_ney_quality, "op8_suffix_array_dedup": op8_suffix_array_dedup, "op9_pii_surrogates": op9_pii_surrogates, "op10_ngram_jaccard_join": op10_ngram_jaccard_join, "pipeline": pipeline}
ORACLES = {"op1_quality_rules": OP1, "op2_warc_index_merge": OP2, "op5_line_dedup": OP5, "op6_sharding": OP6}
