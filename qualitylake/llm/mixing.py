"""Mixing sources to target weights, with DataFrame functions only.

Sizes are summed per source, weights become targets, target / size is a source's repetition rate, and each
document is emitted floor(rate) times plus once more by a Bernoulli draw: a number that is hashed from the seed and
the document's source, id and text is below the source's threshold. The threshold is the fraction of the rate,
moved to where the words drawn come closest to the target, so that small sources meet their targets, too.

Null texts have size 0; null sources form a source of their own; null ids draw by source and text. Rows that equal
in source, id and text share a draw, and count as often as they stand there. Sources without words take nothing.
An empty table gives an empty table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, join_checked, materialize


def word_count(text: str | Column) -> Column:
    """Words of a text; null and empty texts have 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_plan(sized: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Per source its size, weight, target and rate.

    `sized` has `source` and `size`. Sources in code-point order, null last, take the weights in turn. All
    targets add up to share * all sizes; none is above cap * its source's size, and what a source can't take
    goes to the others by weight. With caps c and weights w, target = min(c, w * level); walking sources by
    c / w, the level is the largest of (total - caps before) / (weights left). Windows here see one row a source."""
    if share > cap:
        raise ValueError("the share can't be above the cap")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((rank - 1) % len(weights) + 1).cast("int"))
    weighed = sources.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(float(cap))).alias("_cap"))
    before = Window.orderBy(F.col("_cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    caps, weights_before = (F.coalesce(F.sum(c).over(before), F.lit(0.0)) for c in ("_cap", "weight"))
    levels = weighed.select("*", ((F.lit(share) * F.sum("source_size").over(every) - caps) / (F.sum("weight").over(every) - weights_before)).alias("_level"))
    target = F.least("_cap", F.col("weight") * F.max("_level").over(every))
    planned = levels.select("source", "source_size", "weight", target.alias("target"))
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(cap)), F.col("target") / F.col("source_size"))).otherwise(0.0)
    return planned.withColumn("rate", rate)


def draw_of(seed: int) -> Column:
    """A whole number below 2^32 from the seed and a row's source, id and text; the same in each rerun."""
    key = F.concat_ws("|", F.lit(str(seed)), F.coalesce("source", F.lit("")), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")


def thresholds(sized: DataFrame, plan: DataFrame, n_sources: int) -> DataFrame:
    """The plan with each source's threshold: rows that draw below it are taken once more.

    `sized` has source, size and draw. The threshold lies where the words below it come closest to what the
    fraction asks for. It is found eight bits at a time: draws of the bins that hold the thresholds so far are summed
    in 256 bins, so that no task sees more than 256 sums of a source, however many rows it has."""
    p = plan.withColumn("_need", F.greatest(F.lit(0.0), F.col("target") - F.floor("rate") * F.col("source_size")))
    found = materialize(p.select(F.col("source").alias("_s"), "_need", F.lit(0).cast("long").alias("_high"), F.lit(0).cast("long").alias("_before"), F.lit(0).cast("long").alias("_words")), "bins")
    upto = Window.partitionBy("_s").orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for shift in (24, 16, 8, 0):
        met = join_checked(sized.select("source", "size", "draw"), found, sized["source"].eqNullSafe(found["_s"]) & (F.shiftright(sized["draw"], shift + 8) == found["_high"]), n_sources)
        sums = met.groupBy("_s", "_need", "_before", F.shiftright("draw", shift).alias("_bin")).agg(F.sum("size").alias("_words"))
        run = sums.withColumn("_upto", F.col("_before") + F.sum("_words").over(upto)).where(F.col("_upto") > F.col("_need"))
        first = run.groupBy("_s", "_need").agg(F.min_by(F.struct(F.col("_bin").alias("_high"), (F.col("_upto") - F.col("_words")).alias("_before"), "_words"), "_bin").alias("_f"))
        found = materialize(first.select("_s", "_need", "_f.*"), "bins")
    # the draw that crosses is taken if that comes closer to the need
    at = F.when(F.col("_need") == 0, 0).when(2 * F.col("_before") + F.col("_words") < 2 * F.col("_need"), F.col("_high") + 1).otherwise(F.col("_high"))
    at = found.select(F.col("_s").alias("_t"), at.alias("threshold"))
    # no bin reaches past the need where the fraction takes all words, or there are none
    return p.join(at, p["source"].eqNullSafe(at["_t"]), "left").select(*plan.columns, F.coalesce("threshold", F.when(F.col("_need") > 0, F.lit(1 << 32)).otherwise(0)).cast("long").alias("threshold"))


def planned(docs: DataFrame, weights, share: float, cap: float, seed: int) -> tuple[DataFrame, DataFrame, int]:
    """The documents' numbers (doc_id, source, size, draw), written once, the plan with thresholds, and how many
    sources it has."""
    sized = materialize(docs.select("doc_id", "source", word_count("text").alias("size"), draw_of(seed).alias("draw")), "sizes")
    plan = materialize(source_plan(sized, weights, share, cap), "plan")
    n = plan.count()
    return sized, materialize(thresholds(sized, plan, n), "plan"), n


def with_copies(rows: DataFrame, plan: DataFrame, n_sources: int) -> DataFrame:
    """Add the plan's columns and `copies` to rows that have source and draw."""
    right = plan.withColumnRenamed("source", "_source")
    joined = join_checked(rows, right, rows["source"].eqNullSafe(right["_source"]), n_sources).drop("_source")
    return joined.withColumn("copies", (F.floor("rate") + (F.col("draw") < F.col("threshold")).cast("int")).cast("long"))


def mix_report(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 17) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, source, rate, copies."""
    sized, plan, n = planned(docs, weights, share, cap, seed)
    return with_copies(sized, plan, n).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "rate", "copies")


def mix(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 17) -> DataFrame:
    """The mixed corpus: each row of `docs` as often as the mix takes it, with the columns of `docs`."""
    _, plan, n = planned(docs, weights, share, cap, seed)
    copied = with_copies(docs.select(F.struct(*docs.columns).alias("_row"), "source", draw_of(seed).alias("draw")), plan, n)
    return copied.select("_row", F.explode(F.expr("array_repeat(0, cast(copies as int))")).alias("_copy")).select("_row.*")
