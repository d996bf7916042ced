"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only.

Sources in code point order (null last) weigh by a repeating list and share `share` times all
words; a source's target stops at `limit` times its own words and the excess is shared again by
weight until none is above (the common water level of all sources, found by a prefix sum over
the sources sorted by the level at which they fill).

In a source the expected copies of a document are unequal: a document's class is the power of
two of its size, and a class weighs by CLASS_WEIGHT to its number, so that a longer document is
somewhat likelier; classes share the source's target by the same rule. The whole part of the
expected copies is certain. For the rest p of them documents are ranked by their Pareto key
u / (1 - u) / (p / (1 - p)) with u a hash of the id and the seed, and taken in that order until
their words come nearest to the rest of the source's target: a sample of fixed size in words with
unequal probabilities, of which the same rows always give the same result.

No group is sorted as a whole. Keys are counted in BINS bins; all documents in bins under the one
where the target falls are taken, that bin is counted in BINS bins again, and only the rows of one of
these are ordered.

Null text: 0 words, taken 0. Null source: a source of its own, the last. Null ids and rows that repeat
an id differ by their texts; rows that repeat both tie and are ordered by size and text hash. Very long
texts are counted in the JVM, one at a time. Empty table: no rows. Other columns, whatever their names, do
not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.llm.common import WORD, dropped, stored

BINS, CLASS_WEIGHT = 1024, 1.05


def water_level(df: DataFrame, group: list[str], weight: str, cap: str, total: Column, out: str) -> DataFrame:
    """Share `total` (a column equal within the group) by weight, none above its cap.

    Rows sorted by cap / weight fill in that order; with the k smallest full, the level of the
    others is (total - their caps) / (weights of the others), and a row is full when that level
    reaches cap / weight. Rows: one for each source or class, not for each document.
    """
    by = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    order = by.orderBy(F.col("wl_full"), *[F.col(c) for c in ("src_no", "class") if c in df.columns])
    prior = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    df = df.withColumn("wl_total", total.cast("double")).withColumn("wl_full", F.when(F.col(weight) > 0, F.col(cap) / F.col(weight)).otherwise(F.lit(0.0)))
    df = df.withColumn("wl_level", F.try_divide(F.col("wl_total") - F.coalesce(F.sum(cap).over(prior), F.lit(0.0)), F.sum(weight).over(rest)))
    # past the first row that isn't full the formula gives less, so the greatest is the level
    df = df.withColumn("wl_common", F.max(F.when(F.col("wl_level") < F.col("wl_full"), F.col("wl_level"))).over(by))
    return df.withColumn(out, F.when(F.col("wl_level") < F.col("wl_full"), F.col("wl_common") * F.col(weight)).otherwise(F.col(cap))).drop("wl_total", "wl_full", "wl_level", "wl_common")


def uniform(id_col: Column, text: Column, seed: int) -> Column:
    """In (0, 1), from the first 52 bits of an MD5 of the seed, the id and the text's MD5."""
    name = lambda c: F.coalesce(c, F.lit("null"))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), name(id_col.cast("string")), F.lit(":"), name(F.md5(text.cast("binary")))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7, row_col: str | None = None) -> DataFrame:
    """The columns that sampling needs, without the texts."""
    more = [F.col(row_col).alias("row")] if row_col else []
    size = F.when(F.col(text_col).isNull(), 0).otherwise(F.regexp_count(F.col(text_col), F.lit(WORD))).cast("long")
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), F.xxhash64(text_col).alias("tie"), uniform(F.col(id_col), F.col(text_col), seed).alias("u"), *more)


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, limit: float = 2.0, seed: int = 7, row_col: str | None = None, **cols: str) -> DataFrame:
    """Per row: doc_id, source, size, source_size, target, taken, copies, tie, and with row_col (unique longs) row."""
    rows = kept = stored(measured(docs, seed=seed, row_col=row_col, **cols), "mix-rows")
    rows = rows.withColumn("class", F.when(F.col("size") > 0, F.floor(F.log2(F.col("size").cast("double")) + 1e-9)).otherwise(-1).cast("int"))
    classes = stored(rows.groupBy("source", "class").agg(F.sum("size").cast("double").alias("words")), "mix-classes")
    sources = classes.groupBy("source").agg(F.sum("words").alias("source_size"))
    number = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("src_no", F.lit(len(weights))) + 1).cast("int"))
    sources = sources.withColumn("src_no", number).withColumn("weight", weight).withColumn("cap", F.col("source_size") * limit)
    sources = water_level(sources, [], "weight", "cap", F.sum("source_size").over(Window.partitionBy(F.lit(0))) * share, "target")
    per = classes.join(sources.select("source", "src_no", "source_size", "target"), classes["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    per = per.withColumn("class_weight", F.col("words") * F.pow(F.lit(CLASS_WEIGHT), F.col("class"))).withColumn("class_cap", F.col("words") * limit)
    per = water_level(per, ["src_no"], "class_weight", "class_cap", F.col("target"), "part")
    per = per.withColumn("expected", F.coalesce(F.try_divide("part", "words"), F.lit(0.0))).withColumn("expected", F.when(F.abs(F.col("expected") - F.round("expected")) < 1e-9, F.round("expected")).otherwise(F.col("expected")))
    per = per.withColumn("certain", F.floor("expected")).withColumn("p", F.col("expected") - F.col("certain"))
    rest = F.sum(F.col("words") * F.col("p")).over(Window.partitionBy("src_no"))
    per = stored(per.withColumn("rest", rest).select(F.col("source").alias("s"), F.col("class").alias("c"), "src_no", F.col("source_size").cast("long").alias("source_size"), "target", "certain", "p", "rest"), "mix-plan")
    # joined by AQE's choice: the plan has a row for each source and power of two
    out = rows.join(per, rows["source"].eqNullSafe(per["s"]) & (rows["class"] == per["c"])).drop("s", "c")
    key = F.col("u") / (1 - F.col("u")) / (F.col("p") / (1 - F.col("p")))
    share = F.col("key") / (1 + F.col("key")) * BINS
    bin_ = lambda x: F.least(F.floor(x), F.lit(BINS - 1)).cast("int")
    out = out.withColumn("key", F.when(F.col("p") > 0, key)).withColumn("bin", F.when(F.col("p") > 0, bin_(share))).withColumn("sub", bin_((share - F.col("bin")) * BINS))
    out = stored(out, "mix-keys")
    dropped(kept, classes, per)

    def reached(parts: DataFrame, by: str, below: Column) -> DataFrame:
        """src_no, by, below: the part in which a source's words reach the rest, and the words before it."""
        upto = Window.partitionBy("src_no").orderBy(by)
        parts = parts.withColumn("below", F.sum("words").over(upto) - F.col("words") + below)
        # none, if rounding leaves all words just short of it
        return parts.filter("below + words >= rest and below < rest").groupBy("src_no").agg(F.min_by(F.struct(by, "below"), by).alias("cut")).select("src_no", F.col(f"cut.{by}").alias(f"cut_{by}"), F.col("cut.below").alias(f"below_{by}"))

    bins = out.filter("p > 0").groupBy("src_no", "bin").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    cut = stored(reached(bins, "bin", F.lit(0)), "mix-cuts")
    subs = out.filter("p > 0").join(cut, "src_no").filter("bin = cut_bin").groupBy("src_no", "sub").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"), F.first("below_bin").alias("base"))
    cuts = stored(cut.join(reached(subs, "sub", F.col("base")), "src_no"), "mix-cuts")
    dropped(cut)
    out = out.join(cuts, "src_no", "left")
    edge = Window.partitionBy("src_no").orderBy("key", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cell = "bin = cut_bin and sub = cut_sub"
    at = out.filter(cell).withColumn("run", F.col("below_sub") + F.sum("size").over(edge))
    # the document at the edge comes in if that is nearer than leaving it out
    at = at.withColumn("more", (F.col("run") - F.col("size") / 2 <= F.col("rest")).cast("long")).drop("run")
    away = out.filter(f"not coalesce({cell}, false)").withColumn("more", F.when(F.col("bin").isNull(), 0).when(F.col("cut_bin").isNull(), 1).otherwise(((F.col("bin") < F.col("cut_bin")) | ((F.col("bin") == F.col("cut_bin")) & (F.col("sub") < F.col("cut_sub")))).cast("long")))
    out = away.unionByName(at)
    out = out.withColumn("copies", (F.col("certain") + F.col("more")).cast("long"))
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "tie", *(["row"] if row_col else []))
