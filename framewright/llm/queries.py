"""The queries opN_<name> and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm import common


def op1_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framewright.llm import ts_media

    out = ts_media.media_features(ts_media.media_columns(common.read(spark, sf_dir, "documents")))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op2_histogram_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framewright.llm import packing

    return packing.pack_documents(common.read(spark, sf_dir, "documents"), vocabulary())


def op3_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framewright.llm import cotrain

    out = cotrain.classify(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels"))
    return out.select("doc_id", *cotrain.SCORES)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framewright.llm import url_filter

    return url_filter.judge(common.read(spark, sf_dir, "pages"))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framewright.llm import suffix_dedup

    return suffix_dedup.dedup(common.read(spark, sf_dir, "documents"), 200)


def op6_chained_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framewright.llm import chain_dedup

    return chain_dedup.passages(common.read(spark, sf_dir, "documents"))


def op7_bfd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framewright.llm import sharding

    out = sharding.shard(common.read(spark, sf_dir, "documents"), 16)
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framewright.llm import mixing

    return mixing.mix(common.read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framewright.llm import mih

    return mih.search(common.read(spark, sf_dir, "embeddings"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framewright.llm import ngram_join

    return ngram_join.join(common.read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_transport_stream, op2_histogram_packing, op3_cotraining, op4_url_filter, op5_suffix_array_dedup, op6_chained_passages, op7_bfd_sharding, op8_pareto_mixing, op9_multi_index_hashing, op10_ngram_join)}

#: Words of a text in DuckDB.
_WORDS = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"


def _level(name: str, source: str, group: str, order: str, weight: str, cap: str, total: str, out: str) -> str:
    """CTEs of mixing.water_level."""
    over = f"PARTITION BY {group} " if group else ""
    return f"""{name}1 AS (SELECT *, {total} AS wt, CASE WHEN {weight} > 0 THEN {cap} / {weight} ELSE 0.0 END AS wf FROM {source}),
{name}2 AS (SELECT *, (wt - coalesce(sum({cap}) OVER ({over}ORDER BY wf, {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) / nullif(sum({weight}) OVER ({over}ORDER BY wf, {order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS wl FROM {name}1),
{name} AS (SELECT * EXCLUDE (wt, wf, wl), CASE WHEN wl < wf THEN max(CASE WHEN wl < wf THEN wl END) OVER ({over}) * {weight} ELSE {cap} END AS {out} FROM {name}2)"""


ORACLES: dict[str, str] = {
    "op8_pareto_mixing": f"""WITH d AS (SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE CAST(len({_WORDS.format('text')}) AS BIGINT) END AS size,
(CAST('0x' || substr(md5('7:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || coalesce(md5(text), 'null')), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u FROM documents),
e AS (SELECT *, CASE WHEN size > 0 THEN CAST(floor(log2(size::DOUBLE) + 1e-9) AS INTEGER) ELSE -1 END AS class FROM d),
c AS (SELECT source, class, sum(size)::DOUBLE AS words FROM e GROUP BY 1, 2),
s AS (SELECT source, sum(words) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS src_no FROM c GROUP BY 1),
s0 AS (SELECT *, [3.0::DOUBLE, 1.0, 2.0][src_no % 3 + 1] AS weight, source_size * 2.0::DOUBLE AS cap FROM s),
{_level('t', 's0', '', 'src_no', 'weight', 'cap', '1.5::DOUBLE * (SELECT sum(source_size) FROM s)', 'target')},
p0 AS (SELECT c.*, t.src_no, t.source_size, t.target, words * pow(1.05::DOUBLE, class) AS cw, words * 2.0::DOUBLE AS cc FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source),
{_level('p', 'p0', 'src_no', 'class', 'cw', 'cc', 'target', 'part')},
x AS (SELECT *, CASE WHEN words > 0 THEN part / words ELSE 0 END AS ex FROM p), y AS (SELECT *, CASE WHEN abs(ex - round(ex)) < 1e-9 THEN round(ex) ELSE ex END AS expected FROM x),
z AS (SELECT *, expected - floor(expected) AS p, sum(words * (expected - floor(expected))) OVER (PARTITION BY src_no) AS rest FROM y),
k AS (SELECT e.doc_id, e.size, z.src_no, z.source_size, z.target, floor(z.expected) AS certain, z.p, z.rest, CASE WHEN z.p > 0 THEN e.u / (1 - e.u) / (z.p / (1 - z.p)) END AS key FROM e JOIN z ON e.source IS NOT DISTINCT FROM z.source AND e.class = z.class),
r AS (SELECT *, sum(CASE WHEN p > 0 THEN size ELSE 0 END) OVER (PARTITION BY src_no ORDER BY key NULLS LAST, doc_id ROWS UNBOUNDED PRECEDING) AS run FROM k)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target, CAST(size * (certain + CASE WHEN p > 0 AND run - size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r""",
    "op10_ngram_join": f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS g FROM w),
n AS (SELECT w.doc_id, count(g.g) AS n FROM w LEFT JOIN g ON w.doc_id = g.doc_id GROUP BY 1),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM i JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 75 * (x.n + y.n - c)),
r AS (SELECT doc_id, doc_id AS x FROM n UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.x = l.a)
SELECT r.doc_id, n.n AS n_shingles, min(r.x) AS component_id FROM r JOIN n ON r.doc_id = n.doc_id GROUP BY 1, 2""",
}
