"""Distribution summaries behind the figures: exact quantiles per group,
box-plot statistics, binned kernel density.

Exact quantiles at scale
------------------------
``percentile`` (exact) keeps every distinct value of a group in one task;
with a group holding a third of all rows that does not scale. Here:

1. an approximate quantile sketch per group (bounded memory, mergeable,
   partial aggregation) gives, for every wanted probability p, a bracket
   [lo, hi] that must contain the order statistics needed for p;
2. one algebraic pass counts per group the rows below each bracket and the
   rows inside it -- this *verifies* the bracket (widened and retried if a
   check ever fails, so the result is exact, never approximate);
3. only the rows inside the brackets (about 4/accuracy of the group) go on.
   They collapse to distinct values with counts first (combined before the
   shuffle), so a value that most rows share is one row; a window over the
   distinct values gives each its range of ranks, and the two neighbouring
   order statistics are interpolated linearly (numpy's default definition).

Groups of at most 4 x accuracy rows are ranked whole, once for all wanted
probabilities (a bounded amount per task); only larger groups use the sketch
brackets. The verified bracket table (one row per group) is checkpointed into
the shared checkpoint folder, so a recomputation after executor loss uses the
same brackets.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import DataFrame, Window, functions as F

from ..session import ensure_checkpoint_dir
from ._util import join_groups, join_small


def _literal(v):
    """A literal column for a collected value (structs and arrays included)."""
    from pyspark.sql import Row
    if isinstance(v, Row):
        return F.struct(*[_literal(x).alias(k) for k, x in v.asDict().items()])
    if isinstance(v, (list, tuple)):
        return F.array(*[_literal(x) for x in v])
    return F.lit(v)


def exact_quantiles(df: DataFrame, value: str, probs: Iterable[float], by: Iterable[str] = (),
                    accuracy: int = 100_000, max_rounds: int = 4) -> DataFrame:
    """Exact linear-interpolation quantiles of ``value`` per group.

    Returns (by..., p, q). NULL and NaN values are ignored; a NULL group is a
    group like any other. Brackets that fail their check are widened, in the
    last of ``max_rounds`` to the whole range, which cannot fail. A table
    without values gives no rows.
    """
    by = list(by)
    ensure_checkpoint_dir(df.sparkSession)
    probs = [float(p) for p in probs]
    J = len(probs)
    base = _values(df, value, by)

    def attach(rows: DataFrame, groups: DataFrame) -> DataFrame:
        if by:
            return join_small(rows, groups, by, "inner")
        g = groups.first()  # one row (bounded): the brackets of the whole table
        return rows.select("*", *[_literal(g[c]).alias(c) for c in groups.columns])

    delta = 2.0 / accuracy
    for turn in range(max_rounds):
        if turn == max_rounds - 1:
            delta = 1.0
        lo_p = [max(0.0, p - delta) for p in probs]
        hi_p = [min(1.0, p + delta) for p in probs]
        # group size and both sketches in one aggregation, one row per group
        grp = base.groupBy(*by).agg(
            F.count(F.lit(1)).alias("_n"),
            F.percentile_approx("_x", lo_p, accuracy).alias("_lo"),
            F.percentile_approx("_x", hi_p, accuracy).alias("_hi"))
        # full range for p near 0 or 1, and for small groups (at most
        # 4 x accuracy rows: cheap to rank whole, and their sketch brackets
        # can miss a neighbouring order statistic)
        small = F.col("_n") <= F.lit(4 * accuracy)
        lo = [F.when(small | F.lit(probs[j] - delta <= 0), F.lit(-math.inf)).otherwise(F.col("_lo")[j])
              for j in range(J)]
        hi = [F.when(small | F.lit(probs[j] + delta >= 1), F.lit(math.inf)).otherwise(F.col("_hi")[j])
              for j in range(J)]
        grp = grp.select(*by, "_n", small.alias("_small"), F.array(*[
            F.struct(F.lit(j).alias("j"), F.lit(probs[j]).alias("p"), lo[j].alias("lo"), hi[j].alias("hi"),
                     F.floor(F.lit(probs[j]) * (F.col("_n") - 1)).cast("long").alias("k"))
            for j in range(J)]).alias("_br")).cache()
        tagged = attach(base, grp)
        b = F.col("_br")
        chk = tagged.groupBy(*by).agg(
            *[F.count_if(F.col("_x") < b[j]["lo"]).alias(f"_below{j}") for j in range(J)],
            *[F.count_if((F.col("_x") >= b[j]["lo"]) & (F.col("_x") <= b[j]["hi"])).alias(f"_in{j}")
              for j in range(J)])
        g2 = (join_groups(grp, chk, by) if by else grp.select("*", *[
            _literal(v).alias(k) for k, v in chk.first().asDict().items()]))
        ok = F.lit(True)
        for j in range(J):
            ok = ok & (F.col(f"_below{j}") <= b[j]["k"]) & (
                F.col(f"_below{j}") + F.col(f"_in{j}") >= F.least(b[j]["k"] + 2, F.col("_n")))
        # frozen (reliable checkpoint, tiny): a recomputed sketch after an
        # executor loss could differ from the brackets verified here
        g2 = g2.withColumn("_ok", ok | (F.col("_n") == 0)).checkpoint()
        grp.unpersist()
        if g2.filter(~F.col("_ok")).isEmpty():
            break
        delta *= 8

    # the brackets of a group with their verified "below" counts and wanted ranks;
    # a group that is ranked whole has one bracket for all of its ranks
    b = F.col("_br")

    def wanted(j):
        return F.struct(b[j]["p"].alias("p"), b[j]["k"].alias("k"))

    whole = F.array(F.struct(F.lit(0).alias("j"), F.lit(-math.inf).alias("lo"), F.lit(math.inf).alias("hi"),
                             F.lit(0).cast("long").alias("below"),
                             F.array(*[wanted(j) for j in range(J)]).alias("ranks")))
    cut = F.array(*[F.struct(b[j]["j"].alias("j"), b[j]["lo"].alias("lo"), b[j]["hi"].alias("hi"),
                             F.col(f"_below{j}").alias("below"), F.array(wanted(j)).alias("ranks"))
                    for j in range(J)])
    g3 = g2.select(*by, "_n", F.when(F.col("_small"), whole).otherwise(cut).alias("_br"))

    def holds(e):
        return (F.col("_x") >= e["lo"]) & (F.col("_x") <= e["hi"])

    # distinct values with counts, so that ties are one row, then the brackets that hold them
    values = attach(base, g3).filter(F.exists("_br", holds)).groupBy(*by, "_x").agg(F.count(F.lit(1)).alias("_m"))
    inside = attach(values, g3).select(*by, "_x", "_m", "_n", F.explode(F.filter("_br", holds)).alias("_e"))
    w = Window.partitionBy(*by, F.col("_e.j")).orderBy("_x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = (inside.withColumn("_last", F.col("_e.below") + F.sum("_m").over(w) - 1)
              .withColumn("_first", F.col("_last") - F.col("_m") + 1))
    near = F.filter("_e.ranks", lambda r: (r["k"] + 1 >= F.col("_first")) & (r["k"] <= F.col("_last")))
    near = ranked.select(*by, "_x", "_n", "_first", "_last", F.explode(near).alias("_r"))
    picked = (near.groupBy(*by, F.col("_r.p").alias("p"), "_n", F.col("_r.k").alias("_k"))
              .agg(F.max(F.when(F.col("_r.k").between(F.col("_first"), F.col("_last")), F.col("_x"))).alias("_a"),
                   F.max(F.when((F.col("_r.k") + 1).between(F.col("_first"), F.col("_last")), F.col("_x"))).alias("_b")))
    frac = F.col("p") * (F.col("_n") - 1) - F.col("_k")
    q = F.col("_a") + frac * (F.coalesce(F.col("_b"), F.col("_a")) - F.col("_a"))
    return picked.select(*by, "p", q.alias("q"))


def _values(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """The group keys and the value as ``_x``, without NULL and NaN."""
    x = F.col(value).cast("double")
    return df.filter(x.isNotNull() & ~F.isnan(x)).select(*by, x.alias("_x"))


def box_stats(df: DataFrame, value: str, by: Iterable[str] = (), whis: float = 1.5,
              accuracy: int = 100_000) -> DataFrame:
    """PLT-3: per group the quartiles, the whisker ends (most extreme values
    within ``whis`` x IQR of the box) and the count of points beyond."""
    by = list(by)
    qs = exact_quantiles(df, value, [0.25, 0.5, 0.75], by, accuracy)
    wide = qs.groupBy(*by).agg(
        F.max(F.when(F.col("p") == 0.25, F.col("q"))).alias("q1"),
        F.max(F.when(F.col("p") == 0.5, F.col("q"))).alias("median"),
        F.max(F.when(F.col("p") == 0.75, F.col("q"))).alias("q3"))
    iqr = F.col("q3") - F.col("q1")
    wide = wide.withColumn("_wlo", F.col("q1") - F.lit(whis) * iqr).withColumn(
        "_whi", F.col("q3") + F.lit(whis) * iqr).checkpoint()  # one row per group, read twice
    rows = _values(df, value, by)
    if by:
        t = join_small(rows, wide.select(*by, "_wlo", "_whi"), by, "inner")
    else:  # the whole table: two scalars to the driver, then literals
        lim = wide.first()
        t = rows.withColumn("_wlo", F.lit(lim["_wlo"]).cast("double")).withColumn(
            "_whi", F.lit(lim["_whi"]).cast("double"))
    wh = t.groupBy(*by).agg(
        F.min(F.when(F.col("_x") >= F.col("_wlo"), F.col("_x"))).alias("whisker_lo"),
        F.max(F.when(F.col("_x") <= F.col("_whi"), F.col("_x"))).alias("whisker_hi"),
        F.count_if((F.col("_x") < F.col("_wlo")) | (F.col("_x") > F.col("_whi"))).alias("n_outliers"),
        F.count(F.lit(1)).alias("n"))
    if by:
        return join_groups(wide.drop("_wlo", "_whi"), wh, by)
    return wh.select(*[F.lit(lim[c]).cast("double").alias(c) for c in ("q1", "median", "q3")], "*")


FINE = 1024  # bins of a bandwidth
REACH = 9.0  # bandwidths


def kde(df: DataFrame, value: str, grid_points: int = 100, bins: int | None = None,
        cut: float = 3.0) -> DataFrame:
    """PLT-2: Gaussian kernel density on an even grid, from a fine histogram.

    Bandwidth h by Scott's rule (sample std x n^(-1/5)); the grid spans
    [min - cut*h, max + cut*h]. A bin is h / ``FINE`` wide and adds its rows by
    their count, mean and variance, so that the sum differs from the exact one
    by less than 1e-9 of it however skewed the column is. With ``bins`` the
    histogram has so many equal bins instead, each at its centre; on a skewed
    column such bins are wider than the kernel and the result is not the density.
    Empty bins are absent, and a bin adds its mass to the grid points within
    ``REACH`` h (beyond, a row adds less than 1e-17 of its peak); the others
    are 0. Far outliers make bins many but grid points in reach few, so the
    work stays below about FINE x (max - min) / h pairs. A column without
    spread (one row, or one value) has no density: its grid is the one point,
    with density NULL.
    """
    x = F.col(value).cast("double")
    base = df.filter(x.isNotNull() & ~F.isnan(x)).select(x.alias("_x"))
    # four scalars, one pass, to the driver (bounded)
    st = base.agg(F.count(F.lit(1)).alias("n"), F.min("_x").alias("mn"), F.max("_x").alias("mx"),
                  F.stddev_samp("_x").alias("sd")).first()
    if not st["n"]:
        return df.sparkSession.createDataFrame([], "i int, x double, density double")
    if not st["sd"]:
        return df.sparkSession.createDataFrame([(0, st["mn"], None)], "i int, x double, density double")
    n, mn, mx, sd = (F.lit(st[c]) for c in ("n", "mn", "mx", "sd"))
    h = sd * F.pow(n.cast("double"), F.lit(-0.2))
    bw = h / F.lit(float(FINE)) if bins is None else (mx - mn) / F.lit(float(bins))
    off = F.col("_x") - mn
    at = F.floor(off / bw) if bins is None else F.least(F.floor(off / bw), F.lit(bins - 1))
    hist = base.groupBy(at.alias("bin")).agg(
        F.count(F.lit(1)).alias("m"), F.avg(off).alias("_off"), F.var_pop(off).alias("_v"))
    if bins is not None:
        hist = hist.select("m", ((F.col("bin") + F.lit(0.5)) * bw).alias("_off"), F.lit(0.0).alias("_v"))
    g0 = mn - F.lit(cut) * h
    step = ((mx + F.lit(cut) * h) - g0) / F.lit(float(grid_points - 1))
    center = mn + F.col("_off")
    low = F.greatest(F.ceil((center - F.lit(REACH) * h - g0) / step), F.lit(0))
    high = F.least(F.floor((center + F.lit(REACH) * h - g0) / step), F.lit(grid_points - 1))
    near = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))
    pairs = hist.select("m", "_v", center.alias("_c"), F.explode(near).alias("i"))
    gx = g0 + F.col("i") * step
    z = (gx - F.col("_c")) / h
    contrib = F.col("m") * F.exp(F.lit(-0.5) * z * z) * (F.lit(1.0) + F.col("_v") / (F.lit(2.0) * h * h) * (z * z - 1))
    grid = df.sparkSession.range(grid_points).select(F.col("id").cast("int").alias("i"), F.lit(0.0).alias("_s"))
    dens = pairs.select(F.col("i").cast("int").alias("i"), contrib.alias("_s")).unionByName(grid).groupBy("i").agg(F.sum("_s").alias("_s"))
    norm = n.cast("double") * h * F.lit(math.sqrt(2 * math.pi))
    return dens.select("i", gx.alias("x"), (F.col("_s") / norm).alias("density"))


def kde_by(df: DataFrame, value: str, by: Iterable[str], grid_points: int = 100, cut: float = 3.0) -> DataFrame:
    """PLT-2 per group: the density of ``kde`` with bandwidth, grid and bins of each group's own.

    Returns (by..., i, x, density). Two aggregations: counts and moments per
    group, then all groups' histograms at once, so a group that holds most rows
    is combined before the shuffle like any other. Rows without a value (NULL or
    NaN) take no part; a NULL key is a group. A group without spread (one row,
    or one value) has the one point ``x`` with density NULL; a group without a
    value has no row. A date is its days since 1970-01-01.
    """
    by = list(by)
    ensure_checkpoint_dir(df.sparkSession)
    x = F.unix_date(value).cast("double") if dict(df.dtypes)[value] == "date" else F.col(value).cast("double")
    base = df.select(*by, x.alias("_x")).filter(F.col("_x").isNotNull() & ~F.isnan("_x"))
    h = F.col("_sd") * F.pow(F.col("_n").cast("double"), F.lit(-0.2))
    # one row per group, read three times
    st = base.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.min("_x").alias("_mn"), F.max("_x").alias("_mx"),
                               F.stddev_samp("_x").alias("_sd")).withColumn("_h", h).checkpoint()
    spread = (F.col("_mx") > F.col("_mn")) & (F.col("_h") > 0)
    off = F.col("_x") - F.col("_mn")
    rows = join_small(base, st.filter(spread).select(*by, "_mn", "_h"), by)
    hist = rows.groupBy(*by, F.floor(off / (F.col("_h") / F.lit(float(FINE)))).alias("_bin")).agg(
        F.count(F.lit(1)).alias("_m"), F.avg(off).alias("_off"), F.var_pop(off).alias("_v"))
    lo = F.col("_mn") - F.lit(cut) * F.col("_h")
    step = (F.col("_mx") - F.col("_mn") + F.lit(2.0 * cut) * F.col("_h")) / F.lit(float(grid_points - 1))
    grid = st.filter(spread).select(*by, "_n", "_mn", "_h", lo.alias("_g0"), step.alias("_step"))
    center, reach = F.col("_mn") + F.col("_off"), F.lit(REACH) * F.col("_h")
    low = F.greatest(F.ceil((center - reach - F.col("_g0")) / F.col("_step")), F.lit(0))
    high = F.least(F.floor((center + reach - F.col("_g0")) / F.col("_step")), F.lit(grid_points - 1))
    near = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))
    pairs = join_small(hist, grid, by).select(*by, "_m", "_v", "_h", "_g0", "_step", center.alias("_c"), F.explode(near).alias("i"))
    z = (F.col("_g0") + F.col("i") * F.col("_step") - F.col("_c")) / F.col("_h")
    add = F.col("_m") * F.exp(F.lit(-0.5) * z * z) * (F.lit(1.0) + F.col("_v") / (F.lit(2.0) * F.col("_h") ** 2) * (z * z - 1))
    zero = grid.select(*by, F.explode(F.sequence(F.lit(0), F.lit(grid_points - 1))).alias("i"), F.lit(0.0).alias("_s"))
    dens = pairs.select(*by, F.col("i").cast("int").alias("i"), add.alias("_s")).unionByName(zero)
    dens = join_small(dens.groupBy(*by, "i").agg(F.sum("_s").alias("_s")), grid, by)
    norm = F.col("_n").cast("double") * F.col("_h") * F.lit(math.sqrt(2 * math.pi))
    out = dens.select(*by, "i", (F.col("_g0") + F.col("i") * F.col("_step")).alias("x"), (F.col("_s") / norm).alias("density"))
    return out.unionByName(st.filter(~F.coalesce(spread, F.lit(False))).select(
        *by, F.lit(0).alias("i"), F.col("_mn").alias("x"), F.lit(None).cast("double").alias("density")))
