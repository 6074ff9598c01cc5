"""First crossings and frame counts on streams of cell measurements."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_brightness(stream: DataFrame, time: str, value: str, keys: list[str], window: str, late: str) -> DataFrame:
    """Count, mean and maximum by key and time window; rows later than the watermark are left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window), *keys).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.max(value).alias("top"))


def crossing_events(stream: DataFrame, av_cutoff: float, pi_cutoff: float, keys: tuple[str, ...] = ("identifier", "label"), frame: str = "frame", av: str = "mean_av", pi: str = "mean_pi") -> DataFrame:
    """Events (keys, frame, stain) as cells first reach a cut-off: at most one of each stain a cell.

    Frames of a cell must come in order. Within a frame av is looked at first, and a cell that is
    past av gives no pi event, as in the batch form. State is two flags a cell."""
    kinds = {k: stream.schema[k].dataType.simpleString() for k in keys}

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        had_av, had_pi = state.get if state.exists else (False, False)
        out = []
        for r in pd.concat(list(parts)).sort_values(frame, kind="stable").itertuples(index=False):
            if not had_av and (v := getattr(r, av)) is not None and v >= av_cutoff:
                had_av = True
                out.append((*key, getattr(r, frame), "av"))
            if not had_av and not had_pi and (v := getattr(r, pi)) is not None and v >= pi_cutoff:
                had_pi = True
                out.append((*key, getattr(r, frame), "pi"))
        state.update((had_av, had_pi))
        yield pd.DataFrame(out, columns=[*keys, frame, "stain"])

    schema = ", ".join(f"{k} {t}" for k, t in kinds.items()) + f", {frame} int, stain string"
    return stream.groupBy(*keys).applyInPandasWithState(run, schema, "had_av boolean, had_pi boolean", "append", GroupStateTimeout.NoTimeout)
