"""Mixing sources to target weights by Poisson replication.

A source with target weight w gets the mean repetition rate

    rate = (w / sum of weights) * total / size

where size and total count documents (or another measure) over the whole table. Each document
draws its number of copies by inverting the Poisson distribution with that mean at a uniform
number hashed from (seed, document), is exploded into that many copies, and all copies are
dealt out and sorted by a hash, which is a global shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from asofkit.llm.common import fresh, partitions_for, small, without

#: Source statistics with at most so many rows are broadcast; beyond, the join is a shuffle that splits hot sources.
BROADCAST_SOURCES = 20_000
#: A Poisson mean is split into equal parts of at most this size, whose draws add up: exp(-mean) then never underflows.
PART_MEAN = 16.0
#: The tail of a part beyond so many copies has a probability under 1e-15.
PART_COPIES = 64


def unit(*parts: Column) -> Column:
    """A uniform number in [0, 1) from 52 bits of an MD5, the same in every engine."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def inverse_poisson(u: Column, mean: Column) -> Column:
    """The least k whose cumulative Poisson probability exceeds *u*; sums of terms run upward from k = 0."""
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), F.lit(0).alias("k"))
    step = lambda s, i: F.when(
        u >= s["c"], F.struct((s["p"] * mean / i).alias("p"), (s["c"] + s["p"] * mean / i).alias("c"), i.alias("k"))
    ).otherwise(s)
    return F.aggregate(F.sequence(F.lit(1), F.lit(PART_COPIES)), start, step, lambda s: s["k"])


def mix_to_weights(
    docs: DataFrame,
    weights: Mapping[str, float] | None = None,
    *,
    default_weight: float = 1.0,
    seed: int = 1,
    key: str = "doc_id",
    source: str = "source",
    size: Column | None = None,
    total: float | None = None,
) -> DataFrame:
    """Copies of documents in random order, their sources in the proportions of *weights*.

    Returns the columns of *docs* and ``repetition_rate`` double, ``copy`` int (from 0) and
    ``shuffle_key`` string; input columns of these names are replaced. The rows are hash-dealt by
    shuffle_key and sorted by it inside each partition.

    *weights* maps sources to weights; a source that it lacks, the null source too, has
    *default_weight*. A weight of 0 removes a source. *size* measures a document (1 if not given;
    null and negative measures count as 0); *total* is the sum of measures that the mixture should
    have (that of the input if not given). A source whose measures sum to 0 gets rate 0.

    Draws depend on *key* and *seed* only: rows that repeat a key get equal counts, and rows with a
    null key draw as one. An empty table gives an empty table; text is carried, not read.
    """
    if default_weight < 0 or any(not w >= 0 for w in (weights or {}).values()):
        raise ValueError("weights must be 0 or more")
    docs = without(docs, "repetition_rate", "copy", "shuffle_key")
    spark = docs.sparkSession
    src, rate, measure = fresh(docs, "_mix_source"), "repetition_rate", F.lit(1.0) if size is None else F.greatest(F.coalesce(size.cast("double"), F.lit(0.0)), F.lit(0.0))
    stats = docs.select(F.col(source).alias(src), measure.alias("m")).groupBy(src).agg(F.sum("m").alias("m"))
    weight = F.lit(float(default_weight))
    if weights:
        table = F.create_map(*[F.lit(x) for k, w in weights.items() for x in (k, float(w))])
        weight = F.coalesce(F.try_element_at(table, F.col(src)), weight)
    stats = stats.withColumn("w", weight)
    sums = stats.agg(F.sum("w").alias("w"), F.sum("m").alias("m")).first()  # one row
    if sums["w"] == 0:
        raise ValueError("no source has a weight above 0")
    goal = float(total if total is not None else sums["m"] or 0.0)
    rates = stats.select(src, F.when(F.col("m") > 0, F.col("w") / F.lit(float(sums["w"] or 1.0)) * F.lit(goal) / F.col("m")).otherwise(0.0).alias(rate))
    if small(rates, BROADCAST_SOURCES):
        rates = F.broadcast(rates)
    joined = docs.join(rates, F.col(source).eqNullSafe(F.col(src))).drop(src)
    parts = F.greatest(F.ceil(F.col(rate) / PART_MEAN), F.lit(1)).cast("int")
    draw = lambda i: inverse_poisson(unit(F.lit(seed), F.col(key), i), F.col(rate) / parts)
    single = draw(F.lit(0))
    many = F.aggregate(F.transform(F.sequence(F.lit(0), parts - 1), draw), F.lit(0), lambda a, b: a + b)
    counted = joined.withColumn(n := fresh(joined, "_copies"), F.when(parts == 1, single).otherwise(many)).filter(F.col(n) > 0)
    copies = counted.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col(n) - 1))).drop(n)
    keyed = copies.withColumn("shuffle_key", F.md5(F.concat_ws("|", F.lit(f"order{seed}"), F.coalesce(F.col(key).cast("string"), F.lit("null")), F.col("copy").cast("string"))))
    return keyed.repartition(partitions_for(spark), "shuffle_key").sortWithinPartitions("shuffle_key")

