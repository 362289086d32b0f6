"""Histograms, percentiles, exposure, and differences of rasters.

All are aggregates keyed by image with partial sums before the shuffle; a
histogram has a bounded number of bins for each image, so what follows works on
bins and no longer on pixels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkroom.sources.files import shared_dir

MAX_BINS = 10_000
CLIP_LEVEL, CLIP_PART, MIDDLE = 0.975, 0.25, 0.06


def bins_for(white: float) -> int:
    return int(min(white, MAX_BINS))


def histogram(df: DataFrame, white: float, bins: int | None = None, value: str = "v", image: str = "image_id") -> DataFrame:
    """image, bin and n; equal bins on [0, white], the top edge in the last one,
    values outside left out."""
    n = bins or bins_for(white)
    inside = df.where((F.col(value) >= 0) & (F.col(value) <= white))
    at = F.least(F.floor(F.col(value) / float(white) * n), F.lit(n - 1)).cast("int")
    return inside.groupBy(F.col(image), at.alias("bin")).agg(F.count("*").alias("n"))


def cdf(hist: DataFrame, image: str = "image_id") -> DataFrame:
    """With cum, the count up to a bin, and cdf, its part of all."""
    upto = Window.partitionBy(image).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(image)
    return hist.withColumn("cum", F.sum("n").over(upto)).withColumn("cdf", F.col("cum") / F.sum("n").over(whole))


def percentile(cumulated: DataFrame, p: float, white: float, bins: int, image: str = "image_id") -> DataFrame:
    """The whole part of the left edge of the first bin whose cdf reaches ``p``."""
    return percentiles(cumulated, (p,), white, bins, image).select(image, "value")


def percentiles(cumulated: DataFrame, parts: Sequence[float], white: float, bins: int, image: str = "image_id") -> DataFrame:
    """image, p and value of several percentiles by one aggregate."""
    first = lambda p: F.floor(F.min(F.when(F.col("cdf") >= p, F.col("bin"))) * float(white / bins))
    wide = cumulated.groupBy(image).agg(F.array(*[F.struct(F.lit(float(p)).alias("p"), first(p).alias("value")) for p in parts]).alias("v"))
    return wide.select(image, F.explode("v").alias("v")).select(image, "v.*")


def clip_bin(white: float, bins: int) -> int:
    """The first bin whose left edge reaches 0.975 of white."""
    return next(i for i in range(bins + 1) if i * white / bins >= CLIP_LEVEL * white)


def brighter(white: float, bins: int, part: float = CLIP_PART) -> Column:
    """Aggregate of a cumulated histogram: whether over ``part`` of the pixels lie at
    0.975 of white or above."""
    below = F.coalesce(F.max(F.when(F.col("bin") < clip_bin(white, bins), F.col("cdf"))), F.lit(0.0))
    return (1 - below) > part


def clipped(cumulated: DataFrame, white: float, bins: int, image: str = "image_id") -> DataFrame:
    """Whether over a quarter of an image lies at 0.975 of white or above."""
    return cumulated.groupBy(image).agg(brighter(white, bins).alias("clipped"))


def auto_exposure(hist: DataFrame, white: float, bins: int, pedestal: str | None = None, image: str = "image_id") -> DataFrame:
    """black, median, clipped and exposure of each image.

    Black is the pedestal, a column of ``hist``, where there is one, else the first
    percentile where that is above 0; exposure is log2(0.06 white / median), null
    for clipped or black images."""
    c = cdf(hist, image)
    edge = lambda p: F.floor(F.min(F.when(F.col("cdf") >= p, F.col("bin"))) * float(white / bins))
    given = F.max(pedestal) if pedestal else F.lit(None)
    agg = c.groupBy(image).agg(edge(0.01).alias("p1"), edge(0.5).alias("median"), brighter(white, bins).alias("clipped"), given.cast("long").alias("given"))
    black = F.coalesce("given", F.when(F.col("p1") > 0, F.col("p1")))
    exposure = F.when(~F.col("clipped") & (F.col("median") > 0), F.log2(F.lit(MIDDLE * white) / F.col("median")))
    return agg.select(image, black.alias("black"), "median", "clipped", exposure.alias("exposure"))


def auto_exposure_of(hist: DataFrame, pedestal: str | None = None, image: str = "image_id") -> DataFrame:
    """``auto_exposure`` where each image has white and bins of its own, as columns of
    ``hist``."""
    c = cdf(hist, image)
    left = F.col("bin") * F.col("white") / F.col("bins")
    edge = lambda p: F.floor(F.min(F.when(F.col("cdf") >= p, F.col("bin"))) * F.max(F.col("white") / F.col("bins")))
    below = F.coalesce(F.max(F.when(left < F.col("white") * CLIP_LEVEL, F.col("cdf"))), F.lit(0.0))
    given = F.max(pedestal) if pedestal else F.lit(None)
    agg = c.groupBy(image).agg(edge(0.01).alias("p1"), edge(0.5).alias("median"), ((1 - below) > CLIP_PART).alias("clipped"), given.cast("long").alias("given"), F.max("white").alias("white"))
    black = F.coalesce("given", F.when(F.col("p1") > 0, F.col("p1")))
    exposure = F.when(~F.col("clipped") & (F.col("median") > 0), F.log2(F.col("white") * MIDDLE / F.col("median")))
    return agg.select(image, black.alias("black"), "median", "clipped", exposure.alias("exposure"))


#: Bins of the first pass of an exact percentile.
DIFF_BINS = 4096


def exact_percentile(df: DataFrame, value: str, p: float, by: str) -> DataFrame:
    """``by`` and ``at``: the value at part ``p`` of the sorted values, between its
    neighbours linearly, for each ``by`` and for all (null).

    Values are counted in equal bins first; only the rows of the bins that hold the
    two neighbours are then ranked, so no task sees a group's values."""
    sets = df.select(F.col(value).alias("v"), F.explode(F.array(F.struct(F.lit(False).alias("all"), F.col(by).alias("g")), F.struct(F.lit(True).alias("all"), F.lit(None).cast(df.schema[by].dataType).alias("g")))).alias("s")).where("v is not null").select("v", "s.*")
    ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi")).first()
    if ends.lo is None:
        return sets.select(F.col("g").alias(by), F.col("v").alias("at"))
    width = (ends.hi - ends.lo) / DIFF_BINS or 1.0
    bin_ = F.least(F.floor((F.col("v") - ends.lo) / width), F.lit(DIFF_BINS - 1))
    counted = sets.groupBy("all", "g", bin_.alias("bin")).agg(F.count("*").alias("n"))
    upto = Window.partitionBy("all", "g").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("all", "g")
    ranked = counted.withColumn("cum", F.sum("n").over(upto)).withColumn("place", (F.sum("n").over(whole) - 1) * p)
    # zero-based places of the neighbours, and the bins that hold them
    here = lambda k: (F.col("cum") - F.col("n") <= k) & (k < F.col("cum"))
    bins = ranked.where(here(F.floor("place")) | here(F.ceil("place"))).select("all", "g", "bin", (F.col("cum") - F.col("n")).alias("before"), "place")
    chosen = sets.withColumn("bin", bin_).alias("a").join(F.broadcast(bins).alias("b"), (F.col("a.all") == F.col("b.all")) & F.col("a.g").eqNullSafe(F.col("b.g")) & (F.col("a.bin") == F.col("b.bin"))).select("a.all", "a.g", "a.bin", "before", "place", "v")
    values = chosen.groupBy("all", "g", "bin", "before", "place", "v").agg(F.count("*").alias("n"))
    inside = Window.partitionBy("all", "g", "bin").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    places = values.withColumn("last", F.col("before") + F.sum("n").over(inside) - 1).withColumn("first", F.col("last") - F.col("n") + 1)
    at = lambda k: F.max(F.when((F.col("first") <= k) & (k <= F.col("last")), F.col("v")))
    two = places.groupBy("all", "g").agg(at(F.floor("place")).alias("lo"), at(F.ceil("place")).alias("hi"), F.first(F.col("place") - F.floor("place")).alias("part"))
    return two.select(F.col("g").alias(by), (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("part")).alias("at"))


def diff_stats(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ("image_id", "y", "x", "c"), value: str = "v", by: str = "c") -> DataFrame:
    """mean, p99 and max of the absolute difference in percent, for each ``by``
    and for all (null)."""
    joined = a.select(*keys, F.col(value).alias("_a")).join(b.select(*keys, F.col(value).alias("_b")), list(keys))
    shared_dir(a.sparkSession)
    # several passes read the differences, so the join is done once
    d = joined.select(by, (F.abs(F.col("_a") - F.col("_b")) * 100).alias("d")).checkpoint()
    sums = d.groupingSets([[by], []], by).agg(F.avg("d").alias("mean"), F.max("d").alias("max"))
    high = exact_percentile(d, "d", 0.99, by).select(F.col(by).alias("_by"), F.col("at").alias("p99"))
    return sums.join(F.broadcast(high), F.col(by).eqNullSafe(F.col("_by")), "left").select(by, "mean", "p99", "max")


def min_max(df: DataFrame, value: str = "v", image: str = "image_id") -> DataFrame:
    return df.groupBy(image).agg(F.min(value).alias("min_v"), F.max(value).alias("max_v"))


def size_ratio(df: DataFrame, stored: str, expected: str, by: str) -> DataFrame:
    """Stored bytes over expected bytes."""
    return df.groupBy(by).agg((F.sum(stored) / F.sum(expected)).alias("ratio"))
