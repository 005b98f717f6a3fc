"""Posterior draws as data: long rows (chain, iteration, variable, value).

Iterations of a chain are numbered 1, 2, ... without gaps.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from rollcall.functions.nulls import if_na
from rollcall.functions.scalars import draw_index
from rollcall.functions.tails import normal_quantile, rising
from rollcall.operators.ranks import exact_quantiles, split_row_number
from rollcall.operators.reshape import to_long
from rollcall.session import cut_lineage, shared_table

KEYS = ("chain", "iteration")
# Fixed value: scale that makes the median absolute deviation a sd for normal data.
MAD_SCALE = 1.4826


def draws_to_long(wide: DataFrame, cols: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    return to_long(wide, keys, cols, "variable", "value")


def summarize_draws(draws: DataFrame, by: Sequence[str] = ("variable",)) -> DataFrame:
    """Mean, sd, median, mad and the 2.5, 5, 95 and 97.5 % quantiles."""
    by = list(by)
    q = exact_quantiles(draws, by, "value", {"q2_5": 0.025, "q5": 0.05, "median": 0.5, "q95": 0.95, "q97_5": 0.975},
                        extra={"mean": F.avg("value"), "sd": F.stddev_samp("value")})
    q = shared_table(q)  # one row per key, read twice below; as a file it has a size, so the planner can broadcast it
    spread = (draws.join(q.select(*by, "median"), by)
              .withColumn("dev", F.abs(F.col("value") - F.col("median"))))
    mad = exact_quantiles(spread, by, "dev", {"mad": 0.5}).withColumn("mad", F.col("mad") * MAD_SCALE)
    return q.join(mad, by)


def interval(draws: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """Median and 95 % interval per key."""
    return exact_quantiles(draws, by, value, {"median": 0.5, "lo": 0.025, "hi": 0.975})


def pair_differences(draws: DataFrame, level: str = "variable", keys: Sequence[str] = KEYS,
                     levels: Sequence[str] | None = None) -> DataFrame:
    """Difference of every two levels (of the listed ones) within each draw.

    A draw holds one value per level (a fixed list), folded to one array row;
    each row then gives its level pairs, without a self-join.
    """
    draws = draws if levels is None else draws.filter(F.col(level).isin(list(levels)))
    folded = draws.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(level).alias("l"), F.col("value").alias("v")))).alias("s"))
    first = folded.select(*keys, "s", F.posexplode("s").alias("i", "x"))
    pairs = first.select(*keys, "x", F.explode(F.slice("s", F.col("i") + 2, F.size("s"))).alias("y"))
    return pairs.select(*keys, F.col("x.l").alias("level1"), F.col("y.l").alias("level2"),
                        (F.col("x.v") - F.col("y.v")).alias("value"))


#: Bytes of level arrays that one task of ``pairwise_contrasts`` holds, about, and the tiles that it has at least, if there are as many levels.
TILE_BYTES, LEAST_TILES = 32 << 20, 8


def pairwise_contrasts(draws: DataFrame, level: str = "variable", keys: Sequence[str] = KEYS,
                       levels: Sequence[str] | None = None) -> DataFrame:
    """Mean and 95 % interval of every level difference.

    A level is one row: the array of its values in the order of the draws, one
    value each. Levels are dealt into tiles and joined tile by tile, and mean
    and quantiles are taken inside the row of a pair, so no difference is ever
    shuffled; all steps on arrays are sorts and passes. Draws that only one of two levels has are left out of the pair; a
    level with two values for a draw raises.
    """
    draws = draws if levels is None else draws.filter(F.col(level).isin(list(levels)))
    entry = F.struct(F.struct(*keys).alias("k"), F.col("value").cast("double").alias("v"))
    folded = draws.filter(F.col("value").isNotNull()).groupBy(F.col(level).alias("l")).agg(F.array_sort(F.collect_list(entry)).alias("s"))
    twice = F.raise_error(F.concat(F.lit("two values for a draw of "), F.col("l").cast("string")))
    rows = folded.select("l", F.col("s.k").alias("k"), F.col("s.v").alias("v"))
    # entries are in order, so equal draws stand beside each other
    again = F.exists(F.zip_with(F.slice("k", F.lit(1), F.size("k") - 1), F.slice("k", F.lit(2), F.size("k") - 1), lambda x, y: x == y), lambda x: x)
    rows = rows.withColumn("k", F.when(again, twice).otherwise(F.col("k")))
    rows = shared_table(rows.withColumn("same", F.xxhash64("k")))
    n_levels, longest, sets = rows.agg(F.count(F.lit(1)), F.max(F.size("v")), F.count_distinct("same")).first()
    if sets == 1:  # the same draws everywhere: only values travel
        rows = rows.withColumn("k", F.lit(None).cast(rows.schema["k"].dataType))
    tiles = max(1, min(n_levels, LEAST_TILES), -(-n_levels * 8 * (longest or 1) // TILE_BYTES))
    parts = int(draws.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = F.pmod(F.xxhash64("l"), F.lit(tiles)).cast("int")
    dealt = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    side = lambda p, q: dealt.select(F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own",
                                     *[F.col(c).alias(f"{c}{p}") for c in ("l", "k", "v", "same")]).withColumnRenamed("own", q).repartition(parts, "i", "j")
    # a pair meets in the tile pair of its two tiles alone
    pairs = side(1, "own1").join(side(2, "own2"), ["i", "j"]).filter(
        (F.col("l1") < F.col("l2")) & (F.least("own1", "own2") == F.col("i")) & (F.greatest("own1", "own2") == F.col("j")))
    entries = lambda c: F.zip_with(f"k{c}", f"v{c}", lambda k, v: F.struct(k.alias("k"), F.lit(c).alias("c"), v.alias("v")))
    side_by_side = F.sort_array(F.concat(entries(1), entries(2)))
    near = lambda s: F.zip_with(F.slice(s, F.lit(1), F.size(s) - 1), F.slice(s, F.lit(2), F.size(s) - 1),
                                lambda x, y: F.struct((x["k"] == y["k"]).alias("met"), (x["v"] - y["v"]).alias("d")))
    merged = F.transform(F.array(side_by_side), lambda s: F.transform(F.filter(near(s), lambda z: z["met"]), lambda z: z["d"]))[0]
    alike = F.col("same1") == F.col("same2")
    diff = F.when(alike, F.zip_with("v1", "v2", lambda x, y: x - y)).otherwise(merged)
    # not a filter on the sorted differences: it would be made part of the join, and they be sorted twice
    diffs = pairs.filter(F.when(alike, F.lit(True)).otherwise(F.size(merged) > 0)).select("l1", "l2", F.sort_array(diff).alias("d"))

    def quantile(p: float) -> Column:
        h = (F.size("d") - 1) * p
        low, high = F.get("d", F.floor(h).cast("int")), F.get("d", F.ceil(h).cast("int"))
        return low + (high - low) * (h - F.floor(h))

    mean = F.aggregate("d", F.lit(0.0), lambda s, x: s + x) / F.size("d")
    return diffs.select(F.col("l1").alias("level1"), F.col("l2").alias("level2"), quantile(0.025).alias("lo"), quantile(0.975).alias("hi"), mean.alias("mean"))


def _equal_chains(draws: DataFrame, shortest: bool = False) -> DataFrame:
    """Draws with the length ``n`` of the variable's chains; unequal chains raise,
    or ``n`` is the length of the ``shortest``."""
    lengths = draws.groupBy("variable", "chain").agg(F.count(F.lit(1)).alias("_c"))
    unequal = F.col("_a") if shortest else F.raise_error(F.concat(F.lit("chains of unequal length: "), F.col("variable").cast("string"))).cast("bigint")
    n = lengths.groupBy("variable").agg(F.min("_c").alias("_a"), F.max("_c").alias("_b")).select(
        "variable", F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(unequal).alias("n"))
    return draws.join(n, "variable")


def rhat(draws: DataFrame, shortest: bool = False) -> DataFrame:
    """Split-chain potential scale reduction, of the iterations that all chains have if these
    may be of unequal length (``shortest``)."""
    half = F.floor(F.col("n") / 2)
    part = _equal_chains(draws, shortest).withColumn("n", half).filter(F.col("iteration") <= 2 * F.col("n"))
    part = part.withColumn("_half", F.when(F.col("iteration") <= F.col("n"), 1).otherwise(2))
    chains = part.groupBy("variable", "n", "chain", "_half").agg(
        F.avg("value").alias("m"), F.var_samp("value").alias("v"))
    within, between = F.avg("v"), F.var_samp("m")
    return chains.groupBy("variable", "n").agg(
        F.sqrt(((F.col("n") - 1) / F.col("n") * within + between) / within).alias("rhat")).drop("n")


def split_halves(draws: DataFrame, shortest: bool = False) -> DataFrame:
    """Each chain as two, of its first and its last half; the middle draw of an
    odd chain is left out, as the published measures do. With ``shortest`` the
    halves are those of the shortest chain, and what a longer one has beyond them
    stays in its last half."""
    even = _equal_chains(draws, shortest)
    half = F.floor(F.col("n") / 2)
    late = F.col("iteration") > F.col("n") - half
    return even.filter((F.col("iteration") <= half) | late).select(
        "variable", (2 * F.col("chain") + late.cast("int")).alias("chain"),
        F.when(late, F.col("iteration") - (F.col("n") - half)).otherwise(F.col("iteration")).alias("iteration"), "value")


def rank_normalised(draws: DataFrame) -> DataFrame:
    """Values replaced by the normal quantiles of their ranks over all chains of
    the variable; ties share their mean rank.

    Ranks are counted in 256 slices of the variable's range, so the draws of a
    variable are sorted by many tasks.
    """
    ends = draws.groupBy("variable").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"), F.count(F.lit(1)).alias("_s"))
    place = F.when(F.col("_hi") > F.col("_lo"), F.floor(255 * (F.col("value") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))).otherwise(F.lit(0))
    ranked = split_row_number(draws.join(ends, "variable"), ["variable"], [F.col("value")], {"_slice": place}, "_rank")
    shared = ranked.groupBy("variable", "value").agg(F.avg("_rank").alias("_mean_rank"))
    z = normal_quantile((F.col("_mean_rank") - 0.375) / (F.col("_s") + 0.25))
    return (ranked.join(shared, ["variable", "value"]).select("variable", "chain", "iteration", z.alias("value")))


def _reduction(chains: DataFrame) -> DataFrame:
    """Potential scale reduction of chains as they are."""
    each = chains.groupBy("variable", "chain").agg(F.avg("value").alias("m"), F.var_samp("value").alias("v"), F.count(F.lit(1)).alias("n"))
    within, n = F.avg("v"), F.min("n")
    return each.groupBy("variable").agg(F.sqrt(((n - 1) / n * within + F.var_samp("m")) / within).alias("rhat"))


def rhat_rank(draws: DataFrame, shortest: bool = False) -> DataFrame:
    """Rank-normalised split R-hat: the larger one of the values and of their
    distances from the median."""
    halves = split_halves(draws, shortest)
    middle = exact_quantiles(halves, ["variable"], "value", {"_median": 0.5})
    folded = halves.join(middle.select("variable", "_median"), "variable").select(
        "variable", "chain", "iteration", F.abs(F.col("value") - F.col("_median")).alias("value"))
    both = _reduction(rank_normalised(halves)).unionByName(_reduction(rank_normalised(folded)))
    return both.groupBy("variable").agg(F.max("rhat").alias("rhat"))


def ess_bulk(draws: DataFrame, shortest: bool = False) -> DataFrame:
    """Effective sample size of the rank-normalised half chains."""
    return ess(rank_normalised(split_halves(draws, shortest)), shortest=shortest)


def ess_tail(draws: DataFrame, shortest: bool = False) -> DataFrame:
    """The smaller effective sample size of the indicators of the 5 % and 95 % quantiles."""
    halves = split_halves(draws, shortest)
    cuts = exact_quantiles(halves, ["variable"], "value", {"_q05": 0.05, "_q95": 0.95}).select("variable", "_q05", "_q95")
    sides = halves.join(cuts, "variable")
    below = lambda c: sides.select("variable", "chain", "iteration", (F.col("value") <= F.col(c)).cast("double").alias("value"))
    low, high = (ess(below(c), shortest=shortest) for c in ("_q05", "_q95"))
    return low.unionByName(high).groupBy("variable").agg(F.min("ess").alias("ess"))


def _lag_covariances(dev: DataFrame, lags: range, block: int) -> DataFrame:
    """Covariance of each variable at the given lags, the mean over its chains.

    A chain is cut into blocks of iterations, each with the rows before it that
    the largest lag needs, so a long chain is handled by many tasks and no row
    is copied once per lag.
    """
    block = max(block, 2 * lags[-1])
    here = F.floor(F.col("iteration") / block)
    tail = F.col("iteration") % block >= block - lags[-1]
    cut = dev.select("*", here.alias("_home"), F.explode(F.when(tail, F.array(here, here + 1)).otherwise(F.array(here))).alias("_block"))
    w = W.partitionBy("variable", "chain", "_block").orderBy("iteration")
    ahead = cut.withColumns({f"_l{k}": F.max("d").over(w.rangeBetween(-k, -k)) for k in lags})
    sums = ahead.filter(F.col("_home") == F.col("_block")).groupBy("variable", "chain", "n").agg(
        *[F.sum(F.col("d") * F.col(f"_l{k}")).alias(f"s{k}") for k in lags])
    each = sums.select("variable", "n", F.explode(F.array(*[
        F.struct(F.lit(k).alias("lag"), (F.coalesce(f"s{k}", F.lit(0.0)) / F.col("n")).alias("c")) for k in lags])).alias("_p"))
    return each.groupBy("variable", "n", F.col("_p.lag").alias("lag")).agg(F.avg("_p.c").alias("c"))


def ess(draws: DataFrame, step: int = 20, block: int = 1024, shortest: bool = False) -> DataFrame:
    """Effective sample size from lag covariances, summed in pairs until the
    first pair that is not positive.

    Lags are added ``step`` (an even number) at a time, for the variables whose
    pairs have all been positive so far, until each has turned or its chains
    end: there is no largest lag. Chains of one variable are equally long, or
    only the iterations that all of them have count (``shortest``).
    """
    even = _equal_chains(draws, shortest).select("variable", "chain", "iteration", "n", "value")
    even = even.filter(F.col("iteration") <= F.col("n")) if shortest else even
    means = even.groupBy("variable", "chain").agg(F.avg("value").alias("_m"))
    dev = shared_table(even.join(means, ["variable", "chain"]).select(
        "variable", "chain", "iteration", "n", (F.col("value") - F.col("_m")).alias("d")))
    per_chain = means.groupBy("variable").agg(F.var_samp("_m").alias("between"), F.count(F.lit(1)).alias("chains"))
    first = _lag_covariances(dev, range(0, step), block)
    scale = shared_table(first.filter("lag = 0").join(per_chain, "variable").select(
        "variable", "chains", (F.col("c") * F.col("n") / (F.col("n") - 1)).alias("within"),
        (F.col("c") + F.coalesce("between", F.lit(0.0))).alias("plus")))
    rho = F.when(F.col("lag") == 0, 1.0).otherwise(
        1.0 - (F.col("within") - F.col("c") * F.col("n") / (F.col("n") - 1)) / F.col("plus"))
    lag, now, pairs = 0, first, None
    while True:
        found = (now.join(scale, "variable").groupBy("variable", "n", "chains", F.floor(F.col("lag") / 2).alias("t"))
                 .agg(F.sum(rho).alias("p"), F.max("lag").alias("_last"))
                 .filter((F.col("_last") < F.col("n")) & (F.col("_last") % 2 == 1)))
        found = shared_table(found)
        pairs = found if pairs is None else pairs.unionByName(found)
        lag += step
        going = found.groupBy("variable", "n").agg(F.min("p").alias("_p")).filter((F.col("_p") > 0) & (F.col("n") > lag))
        going = shared_table(going.select("variable"))
        if going.isEmpty():
            break
        now = _lag_covariances(dev.join(going, "variable", "left_semi"), range(lag, lag + step), block)
    w = W.partitionBy("variable").orderBy("t").rowsBetween(W.unboundedPreceding, W.currentRow)
    kept = pairs.withColumn("_low", F.min("p").over(w))
    total = F.sum(F.when(F.col("_low") > 0, F.col("p")).otherwise(0.0))
    return kept.groupBy("variable", "n", "chains").agg(total.alias("_s")).select(
        "variable", (F.col("n") * F.col("chains") / (2.0 * F.col("_s") - 1.0)).alias("ess"))


def direction(draws: DataFrame, by: Sequence[str] = ("variable",), value: str = "value") -> DataFrame:
    """Probability of direction: the larger share of one sign."""
    up = F.avg(F.when(F.col(value) > 0, 1.0).otherwise(0.0))
    down = F.avg(F.when(F.col(value) < 0, 1.0).otherwise(0.0))
    return draws.groupBy(*by).agg(F.greatest(up, down).alias("pd"))


def orient(contrasts: DataFrame, flip) -> DataFrame:
    """Swap the levels and negate where ``flip`` holds."""
    def pick(yes: str, no: str, sign: int = 1):
        return if_na(flip, F.col(yes) * sign if sign < 0 else F.col(yes), F.col(no))

    return contrasts.select(
        pick("level2", "level1").alias("level1"), pick("level1", "level2").alias("level2"),
        pick("mean", "mean", -1).alias("mean"), pick("hi", "lo", -1).alias("lo"), pick("lo", "hi", -1).alias("hi"))


def significance(lo, hi):
    """'***' when the interval leaves out 0, else 'n.s'."""
    return if_na(lo * hi > 0, F.lit("***"), F.lit("n.s"))


def index_posterior(draws: DataFrame, data: DataFrame, index: str) -> DataFrame:
    """Median and interval per index of ``p[index]``, joined to the data rows."""
    indexed = draws.withColumn(index, draw_index(F.col("variable"))).filter(F.col(index).isNotNull())
    return data.join(interval(indexed, [index]), index, "left")


def level_posterior(draws: DataFrame, data: DataFrame, index: str, level: str) -> DataFrame:
    """Draws pooled by a covariate level of their index."""
    indexed = draws.withColumn(index, draw_index(F.col("variable"))).join(data.select(index, level), index)
    return interval(indexed, [level])


def uniform(seed: int, *keys) -> Column:
    """A number in (0, 1) for every value of the keys, from the first 52 bits of md5('seed:key:key').

    It depends on nothing else, so a retried task repeats it, and any engine can.
    """
    text = F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("bigint") + 0.5) / float(1 << 52)


def sample_iterations(draws: DataFrame, n: int, seed: int) -> DataFrame:
    """``n`` iterations drawn without replacement, by the order of md5('seed:chain:iteration')."""
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("chain").cast("string"), F.col("iteration").cast("string")).cast("binary"))
    return draws.select("chain", "iteration").distinct().orderBy(order, "chain", "iteration").limit(n)


def beta_binomial_quantile(u: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray, zero: np.ndarray,
                           rows: int = 256, width: int = 1024) -> np.ndarray:
    """The smallest count whose cumulative probability reaches ``u``, of n trials with a share from Beta(a, b).

    Probabilities follow from each other by their ratio, on the log scale from
    ``zero`` (that of no hit), so none is lost where the first ones are too small
    for a double. Counts are tried ``width`` at a time, for the rows that have
    not reached their ``u``; of a row no more is held, however large n is.
    """
    y = np.zeros(len(u), np.int64)
    for first in range(0, len(u), rows):
        at = np.arange(first, min(first + rows, len(u)))
        at = at[n[at] > 0]
        start, lp, cdf = 0, zero[at], np.zeros(len(at))
        while len(at):
            k = np.arange(start, start + width, dtype=float)
            n_, a_, b_ = n[at][:, None], a[at][:, None], b[at][:, None]
            with np.errstate(all="ignore"):
                step = np.log((n_ - k) * (a_ + k) / ((k + 1) * (b_ + n_ - k - 1)))
                logs = np.cumsum(np.hstack([lp[:, None], step]), axis=1)
                upto = np.cumsum(np.hstack([cdf[:, None], np.exp(logs[:, :-1])]), axis=1)[:, 1:]
                below = (upto < u[at][:, None]) & (k < n_)
            y[at] += below.sum(axis=1)
            start += width
            on = below[:, -1] & (n[at] > start)
            at, lp, cdf = at[on], logs[on, -1], upto[on, -1]
    return y


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        u, a, b, zero = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("_u", "_a", "_b", "_zero"))
        given = batch.column("_size").is_valid().to_numpy(zero_copy_only=False)
        n = batch.column("_size").fill_null(0).to_numpy(zero_copy_only=False)
        y = beta_binomial_quantile(u, n, a, b, zero)
        parameters = [batch.column(c).is_valid().to_numpy(zero_copy_only=False) for c in ("_a", "_b", "_zero")]
        known = given & (n >= 0) & ((n == 0) | np.logical_and.reduce(parameters) & ~((a <= 0) & (n > 1)))
        yield pa.record_batch([*(batch.column(i) for i in range(3)), pa.array(y, pa.int64(), mask=~known)], [*batch.schema.names[:3], "y"])


def simulate_counts(draws: DataFrame, data: DataFrame, index: str, size: str, precision: float | str,
                    n_draws: int = 1000, seed: int = 1) -> DataFrame:
    """Beta-binomial predictive counts for every data row and sampled draw.

    ``draws`` holds one probability per (chain, iteration, index); ``precision``
    is a number, or the column of ``draws`` with that of the same draw. A count
    is the quantile of a uniform number of (seed, index, chain, iteration). The
    rows are few but each tries up to its number of trials, so they are dealt
    over all tasks, however few bytes they have.
    """
    given = F.col(precision) if isinstance(precision, str) else F.lit(float(precision))
    chosen = draws.select(*KEYS, index, F.col("value").alias("_p"), given.alias("_precision")).join(sample_iterations(draws, n_draws, seed), list(KEYS))
    rows = chosen.join(data.select(index, F.col(size).cast("bigint").alias("_size")), index)
    rows = rows.withColumns({"_a": F.col("_p") * F.col("_precision"), "_b": F.col("_precision") - F.col("_p") * F.col("_precision")})
    size, a, b = F.col("_size"), F.col("_a"), F.col("_b")
    rows = rows.select(F.col(index).cast("bigint").alias(index), F.col("chain").cast("bigint").alias("chain"), F.col("iteration").cast("bigint").alias("iteration"),
                       uniform(seed, index, *KEYS).alias("_u"), "_size", "_a", "_b",
                       F.when(size > 0, rising(b, size)["s0"] - rising(a + b, size)["s0"]).alias("_zero"))
    parts = int(draws.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, index, *KEYS).mapInArrow(_counts, f"`{index}` bigint, chain bigint, iteration bigint, y bigint")


def predictive_long(sim: DataFrame, observed: DataFrame, index: str, y: str) -> DataFrame:
    """Predicted and observed counts stacked with a label."""
    pred = sim.select(index, F.lit("y_pred").alias("source"), F.col("y").cast("bigint").alias("y"))
    return pred.unionByName(observed.select(index, F.lit("y").alias("source"), F.col(y).cast("bigint").alias("y")))


def residuals(draws: DataFrame, data: DataFrame, index: str, observed: str) -> DataFrame:
    """Observed minus posterior mean, joined on the index."""
    means = (draws.withColumn(index, draw_index(F.col("variable")))
             .groupBy(index).agg(F.avg("value").alias("fitted")))
    return data.join(means, index, "left").withColumn("resid", F.col(observed) - F.col("fitted"))
