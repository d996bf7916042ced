"""The corpus pipeline: quality, near duplicates, exact repeats, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns
the columns of `documents`; the last returns the packed pieces. run() applies them to `documents`,
writing each result as Parquet in the shared folder and reading it again.

The middle stages tell rows apart by a number (the id where it is unique), so that rows without an id
and rows that repeat one are rows like all others. Extra columns are left out, whatever their names;
an empty table gives no rows in any stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm import common, cotrain, mixing, ngram_join, packing, queries, suffix_dedup
from framewright.shipping import shipped

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the co-trained classifier keeps.

    Null and empty texts are scored like texts without words, null metadata as a category of its own;
    each repeated row is scored; long texts whole.
    """
    return cotrain.classify(docs.select(COLUMNS), common.read(spark, sf_dir, "labels")).filter("keep").select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of the n-gram join: the smallest id, rows without one last, then by number.

    Null, empty and wordless texts link with nothing and all stay; of equal texts one row stays, of
    different texts under one id both.
    """
    rows, _ = common.numbered(docs.select(COLUMNS))
    joined = ngram_join.join(rows, row_col="row")
    heads = joined.groupBy("head").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first")).select("first.row")
    return rows.join(heads, "row", "left_semi").select(COLUMNS)


def exact_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of repeated strings of 200 bytes.

    Bytes that no longer form UTF-8 at a cut become U+FFFD; a text that loses everything goes; null, empty and
    short texts stay as they are. n_chars follows a text that was cut.
    """
    rows, _ = common.numbered(docs.select(COLUMNS))
    cut = suffix_dedup.dedup(rows, 200, keep_text=True, row_col="row").filter("n_removed > 0").select("row", "kept")
    out = rows.join(cut, "row", "left")
    text = F.when(F.col("kept").isNull(), F.col("text")).otherwise(F.make_valid_utf8(F.col("kept").cast("string")))
    out = out.withColumn("text", text).filter("kept is null or text <> ''")
    return out.withColumn("n_chars", F.when(F.col("kept").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it; texts without words are not taken."""
    rows, _ = common.numbered(docs.select(COLUMNS))
    taken = mixing.mix(rows, row_col="row").select("row", "copies").filter("copies > 0")
    return rows.join(taken, "row").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows in sequences of 2048 tokens; a null or empty text is the closing id alone."""
    return packing.pack_documents(docs, queries.vocabulary())


STAGES = [
    ("quality classifier", shipped(quality)),
    ("n-gram Jaccard join", shipped(near_duplicates)),
    ("suffix-array dedup", shipped(exact_repeats)),
    ("mixing sources to target weights", shipped(mix)),
    ("best-fit packing", shipped(pack)),
]

#: SQL can express neither the classifier nor the tokeniser; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of all stages on `documents`; a stage's table is deleted once the next one is written."""
    docs = common.read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        last, docs = docs, stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = common.stored(docs, f"pipeline-{i}")
            common.dropped(last)
            common.released(spark)
    return docs
