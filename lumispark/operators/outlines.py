"""Outlines of planar objects: traced between pixels, smoothed by a periodic spline, filled again."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Pieces of the spline, the range of penalties that are tried, and objects that are solved together.
KNOTS, PENALTIES, TOGETHER = 64, (1e-9, 1e12), 256


def _streamed(rows: DataFrame, keys: list[str], order: list[str], run: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """What run gives for the objects of the sorted rows: whole objects as they come, and where each begins.

    A task holds one batch and the object it ends in; an object costs no call of its own."""

    def tell(parts: list[pd.DataFrame], begins: np.ndarray) -> pd.DataFrame:
        return run(pd.concat(parts, ignore_index=True) if len(parts) > 1 else parts[0].reset_index(drop=True), begins)

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # of one object
        for batch in batches:
            if not len(batch):
                continue
            whole = pd.concat([held[-1].iloc[-1:], batch]) if held else batch
            before, own = whole[keys].iloc[:-1].reset_index(drop=True), whole[keys].iloc[1:].reset_index(drop=True)
            new = np.flatnonzero(~((before == own) | (before.isna() & own.isna())).all(axis=1).to_numpy()) + (0 if held else 1)
            if len(new):
                size = sum(map(len, held))
                first = [0] if size or new[0] else []
                done = [*held, batch.iloc[: new[-1]]]
                yield tell([d for d in done if len(d)], np.concatenate([first, new[:-1] + size]).astype(np.int64))
                held = [batch.iloc[new[-1] :]]
            else:
                held.append(batch)
        if held:
            yield tell(held, np.zeros(1, np.int64))

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(stream, schema)


def _walk(y: np.ndarray, x: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Places of the edges of the longest closed walk with the object on its right; side 0 to 3: above, right, below, left of (y, x)."""
    start = np.stack([y + (side == 2) + (side == 3), x + (side == 1) + (side == 2)], axis=1)
    turn = np.array([[0, 1], [1, 0], [0, -1], [-1, 0]])  # the way along each side
    at = {(a, b, s): k for k, (a, b, s) in enumerate(zip(*start.T.tolist(), side.tolist()))}
    left, best = dict.fromkeys(range(len(y))), []
    while left:
        k = next(iter(left))
        path = []
        while k in left:
            del left[k]
            path.append(k)
            s = int(side[k])
            a, b = (start[k] + turn[s]).tolist()
            # to the right first, so that pixels which meet at a corner only aren't joined
            k = next(at[a, b, t] for t in ((s + 1) % 4, s, (s + 3) % 4) if (a, b, t) in at)
        best = max(best, path, key=len)
    return np.array(best)


def outlines(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, nth, y, x): the middles of the pixel edges around each object, in order; of several closed walks the longest.

    pixels: (keys, y, x) of the objects' pixels, repeated rows counting once. Edges between two pixels of
    an object fall out in a group-by, so a task gathers as many rows as an object has edges outside."""
    y, x = F.col("y").cast("long"), F.col("x").cast("long")
    sides = [(0, y, x, 0), (1, y, x + 1, 1), (0, y + 1, x, 2), (1, y, x, 3)]
    edges = F.explode(F.array(*(F.struct(F.lit(up).alias("up"), a.alias("a"), b.alias("b"), F.lit(s).alias("side")) for up, a, b, s in sides)))
    each = pixels.select(*keys, y.alias("y"), x.alias("x")).distinct().select(*keys, "y", "x", edges.alias("e"))
    lone = each.groupBy(*keys, "e.up", "e.a", "e.b").agg(F.count(F.lit(1)).alias("_n"), *(F.min(c).alias(n) for c, n in (("y", "y"), ("x", "x"), ("e.side", "side")))).filter("_n = 1")

    def run(part: pd.DataFrame, begins: np.ndarray) -> pd.DataFrame:
        own_y, own_x, own_side = (part[c].to_numpy() for c in ("y", "x", "side"))
        walks = [_walk(own_y[a:b], own_x[a:b], own_side[a:b]) + a for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(part)])]
        path = part.iloc[np.concatenate(walks)]
        s = path["side"].to_numpy()
        middle = {"y": path["y"] + np.array([-0.5, 0, 0.5, 0])[s], "x": path["x"] + np.array([0, 0.5, 0, -0.5])[s]}
        return path[keys].assign(nth=np.concatenate([np.arange(len(w)) for w in walks]), **middle)

    kinds = {f.name: f.dataType.simpleString() for f in pixels.schema}
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", nth int, y double, x double"
    return _streamed(lone.select(*keys, "y", "x", "side"), keys, ["y", "x", "side"], run, schema)


def _following(points: DataFrame, keys: list[str]) -> DataFrame:
    """points with _y and _x of the next point, the first after the last."""
    order = Window.partitionBy(*keys).orderBy("nth")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return points.withColumns({f"_{c}": F.coalesce(F.lead(c).over(order), F.first(c).over(whole)) for c in "yx"})


def _weights(f: Column) -> list[Column]:
    """The four cubic pieces that are not 0 at a share f of a piece."""
    return [(1 - f) * (1 - f) * (1 - f) / 6, (3 * f * f * f - 6 * f * f + 4) / 6, (-3 * f * f * f + 3 * f * f + 3 * f + 1) / 6, f * f * f / 6]


def fitted(sums: np.ndarray, sides: np.ndarray, square: float, s: float) -> tuple[np.ndarray, float]:
    """(coefficients, sum of squared residuals) of the smoothest closed curve whose residual is s.

    sums, sides: normal matrix and right sides of the points around their mean, square their squared sum."""
    c, residual = fitted_all(sums[None], sides[None], np.array([square]), s)
    return c[0], float(residual[0])


def fitted_all(sums: np.ndarray, sides: np.ndarray, square: np.ndarray, s: float) -> tuple[np.ndarray, np.ndarray]:
    """The same for many curves of as many knots.

    The penalty is on second differences; the residual rises with it, so it is found by bisection. Where
    even the least penalty leaves more than s, or the largest less, that end is taken."""
    curves, many = sums.shape[:2]
    bend = np.eye(many) * -2 + np.roll(np.eye(many), 1, axis=0) + np.roll(np.eye(many), -1, axis=0)
    bend = bend.T @ bend

    def at(log: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c = np.linalg.solve(sums + 10.0 ** log[:, None, None] * bend, sides)
        return c, square - 2 * (c * sides).reshape(curves, -1).sum(axis=1) + (c * (sums @ c)).reshape(curves, -1).sum(axis=1)

    low, high = (np.full(curves, np.log10(p)) for p in PENALTIES)
    least, most = at(low)[1] >= s, at(high)[1] <= s
    low, high = np.where(most & ~least, high, low), np.where(least, low, high)
    for _ in range(60):
        middle = (low + high) / 2
        under = at(middle)[1] < s
        fixed = least | most
        low, high = np.where(under & ~fixed, middle, low), np.where(under | fixed, high, middle)
    return at(low)


def smoothed(points: DataFrame, keys: list[str], s: float = 5000.0, knots: int = KNOTS) -> DataFrame:
    """(keys, nth, y, x, residual): each closed outline by the smoothest periodic cubic spline that lies
    within a sum of squares of s of its points, at as many places as it had points.

    points: (keys, nth, y, x) in order of nth. The parameter is the length along the outline. Sums of
    products of the basis by piece of the spline are a group-by, so what is solved in a task is knots
    rows an object, whatever its length. Outlines of no length give no row."""
    over = Window.partitionBy(*keys)
    around = _following(points.select(*keys, "nth", F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x")), keys)
    step = F.sqrt((F.col("_y") - F.col("y")) * (F.col("_y") - F.col("y")) + (F.col("_x") - F.col("x")) * (F.col("_x") - F.col("x")))
    along = around.withColumn("_step", step).withColumns({
        "_done": F.coalesce(F.sum("_step").over(over.orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)), "_all": F.sum("_step").over(over),
        "_my": F.avg("y").over(over), "_mx": F.avg("x").over(over), "_n": F.count(F.lit(1)).over(over),
    }).filter("_all > 0")
    place = F.least(F.col("_done") / F.col("_all"), F.lit(1 - 1e-12)) * knots
    based = along.select(*keys, "_my", "_mx", "_n", F.floor(place).cast("int").alias("piece"), (place - F.floor(place)).alias("_f"), (F.col("y") - F.col("_my")).alias("y"), (F.col("x") - F.col("_mx")).alias("x"))
    w = _weights(F.col("_f"))
    products = [F.sum(w[a] * w[b]) for a in range(4) for b in range(4)]
    right = [F.sum(w[a] * F.col(c)) for a in range(4) for c in "yx"]
    sums = based.groupBy(*keys, "_my", "_mx", "_n", "piece").agg(F.array(*products).alias("a"), F.array(*right).alias("b"), F.sum(F.col("y") * F.col("y") + F.col("x") * F.col("x")).alias("q"))

    def solve(part: pd.DataFrame, begins: np.ndarray) -> pd.DataFrame:
        first = part.iloc[begins].reset_index(drop=True)
        object_of = np.repeat(np.arange(len(begins)), np.diff([*begins.tolist(), len(part)]))
        own = (part["piece"].to_numpy()[:, None] + np.arange(4)) % knots
        a, b = (np.array(part[c].tolist(), np.float64) for c in "ab")
        many, coefficients, residuals = len(begins), [], []
        square = np.zeros(many)
        np.add.at(square, object_of, part["q"].to_numpy())
        for at in range(0, many, TOGETHER):
            those = (object_of >= at) & (object_of < at + TOGETHER)
            k, to = object_of[those] - at, own[those]
            matrix, sides = np.zeros((min(TOGETHER, many - at), knots, knots)), np.zeros((min(TOGETHER, many - at), knots, 2))
            np.add.at(matrix, (k[:, None, None], to[:, :, None], to[:, None, :]), a[those].reshape(-1, 4, 4))
            np.add.at(sides, (k[:, None], to), b[those].reshape(-1, 4, 2))
            c, residual = fitted_all(matrix, sides, square[at : at + TOGETHER], s)
            coefficients.append(c)
            residuals.append(residual)
        c = np.concatenate(coefficients)
        places = {f"c{axis}": (c[:, :, k] + first[f"_m{axis}"].to_numpy()[:, None]).tolist() for k, axis in enumerate("yx")}
        return first[keys].assign(many=first["_n"].astype(int), **places, residual=np.concatenate(residuals))

    kinds = {f.name: f.dataType.simpleString() for f in points.schema}
    # sums in one order, whatever came first
    curves = _streamed(sums, keys, ["piece"], solve, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", many int, cy array<double>, cx array<double>, residual double")
    spread = curves.withColumn("nth", F.explode(F.sequence(F.lit(0), F.col("many") - 1)))
    at = F.col("nth") / F.col("many") * knots
    piece, pieces = F.floor(at).cast("int"), _weights(at - F.floor(at))
    value = lambda c: sum(pieces[k] * F.get(c, (piece + k) % knots) for k in range(4))
    return spread.select(*keys, "nth", value("cy").alias("y"), value("cx").alias("x"), "residual")


def filled(points: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, y, x0, x1): runs of the pixels whose centres lie inside a closed outline, by the even-odd rule.

    Each piece of the outline crosses the rows between its ends; a row's crossings are paired in order.
    Centres on a left or upper border count as inside, on a right or lower one not."""
    ends = _following(points, keys).select(*keys, "nth", F.least("y", "_y").alias("_low"), F.greatest("y", "_y").alias("_high"), "y", "x", "_y", "_x")
    rows = F.sequence(F.ceil("_low"), F.ceil("_high") - 1)
    met = ends.filter(F.ceil("_low") <= F.ceil("_high") - 1).withColumn("row", F.explode(rows))
    cross = met.select(*keys, "row", (F.col("x") + (F.col("row") - F.col("y")) * (F.col("_x") - F.col("x")) / (F.col("_y") - F.col("y"))).alias("at"))
    order = Window.partitionBy(*keys, "row").orderBy("at")
    pairs = cross.withColumns({"_nth": F.row_number().over(order), "_to": F.lead("at").over(order)}).filter("_nth % 2 = 1")
    return pairs.select(*keys, F.col("row").alias("y"), F.ceil("at").alias("x0"), (F.ceil("_to") - 1).alias("x1")).filter("x0 <= x1")
