"""Detectors that need ordered numeric work: change-points and isolation forests, per group in pandas."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.streaming.live import folder

MAX_POINTS = 2_000  # per piece of a series, as the cost grows with the square; longer ones are cut in overlapping pieces
CORE = MAX_POINTS // 2  # values that a piece of a longer series decides on; the rest is margin, half of it on each side


def pelt(x: np.ndarray, penalty: float = 3.0, min_size: int = 10, scale: float | None = None) -> list[int]:
    """Starts of segments after the first, by pruned exact search with an RBF kernel cost.

    ``scale`` is the kernel's squared width, the median squared distance of ``x`` if none is given.
    """
    n = len(x)
    if n < 2 * min_size:
        return []
    apart = (x[:, None] - x[None, :]) ** 2
    scale = np.median(apart[np.triu_indices(n, 1)]) if scale is None else scale
    total = np.zeros((n + 1, n + 1))
    total[1:, 1:] = np.exp(-apart / scale if scale > 0 else -apart).cumsum(0).cumsum(1)
    best, last, open_ = np.full(n + 1, np.inf), np.zeros(n + 1, int), [0]
    best[0] = -penalty
    for end in range(min_size, n + 1):
        starts = np.array([s for s in open_ if end - s >= min_size])
        if len(starts):
            size = end - starts
            inside = total[end, end] - total[starts, end] - total[end, starts] + total[starts, starts]
            cost = best[starts] + size - inside / size
            k = int(cost.argmin())
            best[end], last[end] = cost[k] + penalty, starts[k]
            gone = set(starts[cost > best[end]].tolist())
            open_ = [s for s in open_ if s not in gone]
        if end + 1 - min_size >= min_size:
            open_.append(end + 1 - min_size)
    found, end = [], n
    while end > 0:
        end = last[end]
        if end:
            found.append(int(end))
    return found[::-1]


def _filled(rows: DataFrame, least: int = 20) -> DataFrame:
    """(session, signal, us, value, n, extent, k): the rows of each series with ``least`` valid values or more that differ, numbered
    from 0 in order of time, a missing value filled with the one before, at the start with the first.

    Positions and values to fill with are found within spans of time and carried over spans, so no
    task orders a long series.
    """
    v = F.col("value").cast("double")
    x = rows.select("session", "signal", "us", "row_id", F.when(~F.isnan(v), v).alias("value"))
    key = ["session", "signal"]
    at = F.struct("us", "row_id")
    stats = x.groupBy(key).agg(
        F.count("*").alias("n"), F.count("value").alias("valid"), F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.min("value").alias("lo"), F.max("value").alias("hi"),
        F.min_by("value", F.when(F.col("value").isNotNull(), at)).alias("first"),
    )
    stats = stats.where((F.col("valid") >= least) & (F.col("hi") > F.col("lo")))
    span = F.floor((F.col("us") - F.col("first_us")) / F.greatest(F.lit(1.0), (F.col("last_us") - F.col("first_us")) / F.ceil(F.col("n") / CORE)))
    x = x.join(stats, key).withColumn("span", span)
    spans = x.groupBy(*key, "span").agg(F.count("*").alias("c"), F.max_by("value", F.when(F.col("value").isNotNull(), at)).alias("v"))
    up = Window.partitionBy(key).orderBy("span")
    spans = spans.select(*key, "span", (F.sum("c").over(up) - F.col("c")).alias("c0"), F.last("v", ignorenulls=True).over(up.rowsBetween(Window.unboundedPreceding, -1)).alias("v0"))
    inside = Window.partitionBy(*key, "span").orderBy("us", "row_id")
    x = x.withColumn("i", F.row_number().over(inside) - 1).withColumn("near", F.last("value", ignorenulls=True).over(inside))
    filled = F.coalesce("near", "v0", "first")
    return x.join(spans, [*key, "span"]).select(*key, "us", filled.alias("value"), "n", (F.col("hi") - F.col("lo")).alias("extent"), (F.col("c0") + F.col("i")).alias("k"))


def change_points(rows: DataFrame, penalty: float = 3.0, min_size: int = 10) -> DataFrame:
    """A2: (session, signal, at_us, start_us, end_us, shift, score): level shifts of each series of 20 valid values or more.

    Missing values are filled from their neighbours. The window is ``max(min_size // 2, 2)`` rows at either side of the
    shift, the shift the difference of their means, the score that over the series' range, at most 1. A series of more
    than ``MAX_POINTS`` values is searched in pieces that overlap by half, spread over tasks, with one kernel width of
    the whole series (of ``MAX_POINTS`` evenly spaced values). Each piece decides on the ``CORE`` values in its middle
    and ``min_size`` beyond; of the shifts closer than ``min_size`` that neighbouring pieces find, one stays.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    key, kind = ["session", "signal"], f"session {kinds['session']}, signal {kinds['signal']}"
    x, half = _filled(rows), max(min_size // 2, 2)

    def width(group: pd.DataFrame) -> pd.DataFrame:
        v = group.sort_values("k")["value"].to_numpy(float)
        v = (v - v.mean()) / (v.std() or 1.0)
        scale = np.median(((v[:, None] - v[None, :]) ** 2)[np.triu_indices(len(v), 1)])
        return pd.DataFrame({"session": [group["session"].iloc[0]], "signal": [group["signal"].iloc[0]], "mean": [group["value"].mean()], "std": [group["value"].std(ddof=0)], "scale": [scale]})

    even = x.where(F.col("k") % F.ceil(F.col("n") / MAX_POINTS) == 0)
    widths = even.groupBy(key).applyInPandas(width, f"{kind}, mean double, std double, scale double")
    margin = (MAX_POINTS - CORE) // 2
    last = F.when(F.col("n") <= MAX_POINTS, 0).otherwise(F.ceil(F.col("n") / CORE) - 1)
    low, high = (F.least(F.greatest(F.floor((F.col("k") + d) / CORE), F.lit(0)), last).cast("int") for d in (-margin, margin))
    pieces = x.join(widths, key).withColumn("piece", F.explode(F.sequence(low, high)))
    fields = [*key, "k", "us", "start_us", "end_us", "shift", "score", "own"]

    def search(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values("k")
        one, piece, n = g.iloc[0], int(g["piece"].iloc[0]), int(g["n"].iloc[0])
        v, us, k = g["value"].to_numpy(float), g["us"].to_numpy(), g["k"].to_numpy()
        cuts = np.array(pelt((v - one["mean"]) / (one["std"] or 1.0), penalty, min_size, float(one["scale"])), int)
        start, end = (0, n) if n <= MAX_POINTS else (piece * CORE, (piece + 1) * CORE)
        cuts = cuts[(k[cuts] >= start - min_size) & (k[cuts] < end + min_size)] if len(cuts) else cuts
        shift = np.array([abs(v[c : c + half].mean() - v[max(0, c - half) : c].mean()) for c in cuts], float)
        return g.iloc[cuts].assign(
            start_us=us[np.maximum(cuts - half, 0)], end_us=us[np.minimum(cuts + half - 1, len(us) - 1)], shift=shift,
            score=np.minimum(1.0, shift / one["extent"]), own=(k[cuts] >= start) & (k[cuts] < end),
        )[fields]

    schema = f"{kind}, k long, us long, start_us long, end_us long, shift double, score double, own boolean"
    found = pieces.groupBy(*key, "piece").applyInPandas(search, schema)
    found = found.groupBy(*fields[:-1]).agg(F.max("own").alias("own"))
    order = Window.partitionBy(key).orderBy("k")
    far = F.coalesce((F.col("k") - F.lag("k").over(order) >= min_size).cast("int"), F.lit(1))
    found = found.withColumn("far", far).withColumn("island", F.sum("far").over(order))

    def settle(group: pd.DataFrame) -> pd.DataFrame:
        kept: list = []
        for at, k in group.sort_values(["own", "k"], ascending=[False, True])["k"].items():
            if all(abs(k - group["k"][other]) >= min_size for other in kept):
                kept.append(at)
        return group.loc[kept, fields]

    cuts = found.drop("far").groupBy(*key, "island").applyInPandas(settle, schema)
    return cuts.select(*key, F.col("us").alias("at_us"), "start_us", "end_us", "shift", "score")


def _mean_depth(n: np.ndarray) -> np.ndarray:
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


TREES, TREE_ROWS, POOL = 100, 256, 4096  # trees of a forest, rows that each is grown on, rows of a session that these are drawn from at most
PIECE = 4 * POOL  # rows of a session that a task scores at a time, about


def grow(x: np.ndarray, trees: int = TREES, sample: int = TREE_ROWS, seed: int = 42) -> list[np.ndarray]:
    """Isolation trees on random rows of ``x``: arrays of (column or -1, cut, left, right, depth at a leaf), one row a node."""
    draw = np.random.default_rng(seed)
    size = min(sample, len(x))
    limit = int(np.ceil(np.log2(max(2, size))))
    forest = []
    for _ in range(trees):
        nodes: list = [None]
        stack = [(0, draw.choice(len(x), size, replace=False), 0)]
        while stack:
            at, rows, depth = stack.pop()
            low, high = x[rows].min(0), x[rows].max(0)
            wide = np.nonzero(high > low)[0]
            if len(rows) <= 1 or depth >= limit or not len(wide):
                nodes[at] = (-1, 0.0, 0, 0, depth + float(_mean_depth(len(rows))))
                continue
            j = draw.choice(wide)
            cut = draw.uniform(low[j], high[j])
            cut = cut if cut > low[j] else high[j]  # of close values the draw may be the lower one, which would leave no row below
            below = x[rows, j] < cut
            nodes[at] = (j, cut, len(nodes), len(nodes) + 1, 0.0)
            stack += [(len(nodes), rows[below], depth + 1), (len(nodes) + 1, rows[~below], depth + 1)]
            nodes += [None, None]
        forest.append(np.array(nodes, float))
    return forest


def isolation_scores(x: np.ndarray, forest: list[np.ndarray] | None = None, size: int | None = None) -> np.ndarray:
    """Anomaly scores 0..1 of the rows of ``x``; near 1 is odd. ``size`` is the number of rows that each tree was grown on."""
    forest = grow(x) if forest is None else forest
    size = min(TREE_ROWS, len(x)) if size is None else size
    depths = np.zeros(len(x))
    for tree in forest:
        at = np.zeros(len(x), int)
        while True:
            column = tree[at, 0].astype(int)
            inner = np.nonzero(column >= 0)[0]
            if not len(inner):
                break
            node = at[inner]
            at[inner] = np.where(x[inner, column[inner]] < tree[node, 1], tree[node, 2], tree[node, 3]).astype(int)
        depths += tree[at, 4]
    return 2 ** (-depths / len(forest) / max(1e-9, float(_mean_depth(size))))


def isolation_forest(wide: DataFrame, key: str, at: str, columns: list[str], share: float = 0.05, least: int = 30, most_signals: int = 5) -> DataFrame:
    """(key, start, end, n_rows, signals, score): the runs of neighbouring rows among the ``share`` most isolated ones of
    each key with ``least`` rows or more and two varying columns. A missing value is filled with the one before, at the start with the
    next; columns count as deviations from the key's mean. A run's signals are the ``most_signals`` of largest mean deviation,
    its score how far the rows lie above the key's limit on average, 0 to 1.

    A key's forest is grown on about ``POOL`` of its rows at most, alike in each of the pieces of ``PIECE`` rows in which it scores them.
    """
    back = Window.partitionBy(key).orderBy(at)
    ahead = Window.partitionBy(key).orderBy(F.desc(at))
    x = wide.select(key, at, *[F.coalesce(F.last(c, ignorenulls=True).over(back), F.last(c, ignorenulls=True).over(ahead)).cast("double").alias(c) for c in columns])
    stats = x.groupBy(key).agg(F.count("*").alias("n_"), *[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns])
    varying = F.array_compact(F.array(*[F.when(F.col(f"s_{c}") > 0, F.lit(c)) for c in columns]))
    stats = stats.where((F.col("n_") >= least) & (F.size(varying) >= 2))
    z = [F.coalesce((F.col(c) - F.col(f"m_{c}")) / F.when(F.col(f"s_{c}") > 0, F.col(f"s_{c}")), F.lit(0.0)) for c in columns]
    x = x.join(stats, key).select(key, at, F.array(*z).alias("z"), varying.alias("varying"), "n_")
    kinds = {f.name: f.dataType.simpleString() for f in x.schema}
    # about POOL rows a key, by a hash of their place, so that no window counts a long series
    pool = x.where(F.pmod(F.xxhash64(F.col(key).cast("string"), F.col(at).cast("string")), F.col("n_")) < POOL)

    # pieces of a key's rows, each with the rows that the forest is drawn from: a forest, some 2 MB, is grown where it is used and never sent
    pieces = F.ceil(F.col("n_") / PIECE).cast("int")
    own = x.withColumns({"piece": F.pmod(F.xxhash64(at), pieces).cast("int"), "own": F.lit(True)})
    drawn = pool.withColumn("piece", F.explode(F.sequence(F.lit(0), pieces - 1))).withColumn("own", F.lit(False))

    def score_of(group: pd.DataFrame) -> pd.DataFrame:
        mine = group["own"].to_numpy(bool)
        rows = np.array(group[~mine].sort_values(at)["z"].tolist(), float)
        scored = group.loc[mine, [key, at, "z", "varying"]]
        if not len(rows):
            return scored.assign(s=0.0)  # a pool is empty in theory only
        return scored.assign(s=isolation_scores(np.array(scored["z"].tolist(), float), grow(rows), min(TREE_ROWS, len(rows))))

    # few bytes and much work: so many tasks whatever the bytes, and once, as the limits and the runs both read the scores
    both = own.unionByName(drawn).repartition(int(wide.sparkSession.conf.get("spark.sql.shuffle.partitions")), key, "piece")
    path = folder(wide.sparkSession, "isolation")
    both.groupBy(key, "piece").applyInPandas(score_of, f"{key} {kinds[key]}, {at} {kinds[at]}, z array<double>, varying array<string>, s double").write.parquet(path)
    scored = wide.sparkSession.read.parquet(path)
    limits = scored.groupBy(key).agg(F.percentile("s", F.lit(1 - share)).alias("limit"))
    y = scored.join(limits, key).withColumn("odd", F.col("s") > F.col("limit"))
    opens = F.col("odd") & ~F.coalesce(F.lag("odd").over(back), F.lit(False))
    y = y.withColumn("run", F.sum(opens.cast("int")).over(back)).where("odd")
    deviations = [F.avg(F.abs(F.col("z")[k])).alias(f"d_{c}") for k, c in enumerate(columns)]
    runs = y.groupBy(key, "run").agg(F.min(at).alias("start"), F.max(at).alias("end"), F.count("*").alias("n_rows"), F.avg(F.col("s") - F.col("limit")).alias("score"), F.any_value("varying").alias("varying"), *deviations)
    ranked = F.array_sort(F.array(*[F.struct((-F.col(f"d_{c}")).alias("d"), F.lit(c).alias("signal")) for c in columns]))
    top = F.slice(F.filter(F.transform(ranked, lambda r: r["signal"]), lambda s: F.array_contains("varying", s)), 1, most_signals)
    return runs.select(key, "start", "end", "n_rows", top.alias("signals"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("score"))).alias("score"))
