"""Heat maps from stored values: grid layout, patch saliency, fusion over
models and the threshold mask.  Values are kept in integer form (sums of
integer micro-units) so min-max results are exact fractions ``num / den``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def grid_height(n: Column) -> Column:
    """M6: the largest divisor of ``n`` not above ``sqrt(n)``."""
    r = F.floor(F.sqrt(n.cast("double"))).cast("int")
    return F.array_max(F.filter(F.sequence(F.lit(1), F.greatest(r, F.lit(1))), lambda h: n % h == 0))


def grid_layout(n: Column) -> Column:
    """M6: ``struct(h, w)`` with ``h * w = n``."""
    h = grid_height(n)
    return F.struct(h.alias("h"), (n / h).cast("int").alias("w"))


def cell_position(pos: Column, w: Column) -> Column:
    return F.struct((pos / w).cast("int").alias("row"), (pos % w).cast("int").alias("col"))


def minmax(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Min-max inside ``keys`` as ``num = v - min`` and ``den = max - min``.
    A window over one map's cells (bounded by the grid size)."""
    w = Window.partitionBy(*keys)
    return (df.withColumn("_mn", F.min(value).over(w)).withColumn("_mx", F.max(value).over(w))
              .withColumn("num", F.col(value) - F.col("_mn")).withColumn("den", F.col("_mx") - F.col("_mn"))
              .drop("_mn", "_mx"))


def heat_fuse(cells: DataFrame) -> DataFrame:
    """A10: ``cells(image, tag, model, cell, v)`` -> mean over models per
    cell (kept as the sum: every model covers the whole grid, so the count
    is the same for all cells of a map), then min-max per (image, tag)."""
    s = cells.groupBy("image", "tag", "cell").agg(F.sum("v").cast("bigint").alias("s"),
                                                  F.count(F.lit(1)).cast("bigint").alias("n_models"))
    return minmax(s, ["image", "tag"], "s").select("image", "tag", "cell", "n_models", "num", "den")


def heat_mask(num: Column, den: Column, threshold: float, alpha: float) -> Column:
    """M7: ``alpha * 255`` (as uint8) where the normalised value is at or
    above the threshold, else 0.  ``num / den >= thr`` is tested exactly as
    ``num * 10^6 >= thr_micro * den``; a flat map (``den = 0``) has the
    value 0 everywhere."""
    a = int(alpha * 255)
    thr = int(round(threshold * 1_000_000))
    hot = F.when(den == 0, F.lit(thr <= 0)).otherwise(num * 1_000_000 >= F.lit(thr) * den)
    return F.when(hot, F.lit(a)).otherwise(F.lit(0))


def patch_saliency(acts: DataFrame, grads: DataFrame) -> DataFrame:
    """M5 from stored activations ``(image, patch, e, a)`` and gradients
    ``(image, patch, e, g)``: weight per dim = gradient summed over patches
    (the mean times a positive constant), value per patch =
    ``relu(sum_e a * weight)``, min-max per image, placed on the grid."""
    wts = grads.groupBy("image", "e").agg(F.sum("g").alias("wt"))
    j = acts.join(wts, ["image", "e"], "inner")
    v = j.groupBy("image", "patch").agg(F.greatest(F.sum(F.col("a") * F.col("wt")), F.lit(0)).cast("bigint").alias("v"))
    n = F.count(F.lit(1)).over(Window.partitionBy("image"))
    v = v.withColumn("n", n.cast("int"))
    v = v.withColumn("g", grid_layout(F.col("n")))
    v = v.withColumn("rc", cell_position(F.col("patch"), F.col("g.w")))
    v = minmax(v, ["image"], "v")
    return v.select("image", "patch", F.col("rc.row").alias("row"), F.col("rc.col").alias("col"), "num", "den")
