"""Durations: ordered folds over a key's records, in batch as expressions and on streams as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# ---- fixed values of the duration model
DECAY, LEAST_FIT, OUTLIER, OUTLIER_WEIGHT, KEEP, TAKE = 0.9, 3, 5.0, 0.3, 0.7, 0.3
_STATE = "struct<n:double,sx:double,sy:double,sxx:double,sxy:double,seen:int>"


def ewma(ordered: Column, keep: float = KEEP, take: float = TAKE) -> Column:
    """Of array<double>: the first value, then keep * average + take * value."""
    rest = F.slice(ordered, 2, F.greatest(F.size(ordered) - 1, F.lit(0)))
    return F.aggregate(rest, F.element_at(ordered, 1), lambda a, x: a * keep + x * take)


#: Records that an average still hears of: 0.7 ** 256 is far below the last bit of any double.
HEARD = 256


def ewma_by(events: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """(key, records, average). Each partition hands on a key's last HEARD records only: what is older has no weight."""
    some = events.where(F.col(value).isNotNull())
    last = Window.partitionBy(key).orderBy(*(F.desc(c) for c in order))
    heard = some.select(key, *order, F.col(value).alias("v")).withColumn("_rn", F.row_number().over(last)).where(F.col("_rn") <= HEARD)
    rows = heard.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, "v"))).alias("rows"))
    averages = rows.select(key, ewma(F.transform("rows", lambda r: r["v"])).alias("average"))
    return some.groupBy(key).agg(F.count(F.lit(1)).alias("records")).join(averages, key)


def predicted(s: Column, units: Column) -> Column:
    """Seconds for `units` by the state's decayed least squares: slope and intercept not below 0; with few records or
    one size only, the mean in proportion to the size; null without records."""
    mean_x, mean_y = s["sx"] / s["n"], s["sy"] / s["n"]
    spread = s["n"] * s["sxx"] - s["sx"] * s["sx"]
    slope = F.greatest(F.lit(0.0), (s["n"] * s["sxy"] - s["sx"] * s["sy"]) / spread)
    line = F.greatest(F.lit(0.0), (s["sy"] - slope * s["sx"]) / s["n"]) + slope * units
    fits = (s["seen"] >= LEAST_FIT) & (spread > F.greatest(F.lit(1.0), s["n"] * s["sxx"]) * 1e-9)
    ratio = F.when(mean_x > 0, mean_y * units / mean_x).otherwise(mean_y)
    return F.when((s["seen"] == 0) | (s["n"] <= 0), F.lit(None).cast("double")).when(units.isNull(), mean_y).when(fits, line).otherwise(ratio)


def fitted(ordered: Column) -> Column:
    """Final state over array<struct<units,seconds>>: a record that took over five times its prediction counts 0.3."""
    zero = F.struct(*(F.lit(0.0).alias(c) for c in ("n", "sx", "sy", "sxx", "sxy")), F.lit(0).alias("seen")).cast(_STATE)

    def step(s, r):
        guess = predicted(s, r["units"])
        w = F.when((guess > 0) & (r["seconds"] > guess * OUTLIER), OUTLIER_WEIGHT).otherwise(1.0)
        add = lambda c, v: (s[c] * DECAY + w * v).alias(c)
        one = F.lit(1.0)
        return F.struct(add("n", one), add("sx", r["units"]), add("sy", r["seconds"]), add("sxx", r["units"] * r["units"]), add("sxy", r["units"] * r["seconds"]), (s["seen"] + 1).alias("seen")).cast(_STATE)

    return F.aggregate(ordered, zero, step)


def usable(records: DataFrame) -> DataFrame:
    """Drops records without a key and with negative, missing or non-finite numbers."""
    fine = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.col(c) >= 0) & (F.col(c) < float("inf"))
    return records.where((F.coalesce("key", F.lit("")) != "") & fine("units") & fine("seconds"))


def fallback_keys(key: Column) -> Column:
    """The key and its wider prefixes, narrow to wide; judge keys stop at two parts."""
    parts = F.split(key, ":")
    floor = F.when(parts[0] == "judge", 2).otherwise(1)
    n = F.size(parts)
    return F.when(n >= floor, F.transform(F.sequence(n, F.least(floor, n), F.lit(-1)), lambda k: F.array_join(F.slice(parts, 1, k), ":"))).otherwise(F.array().cast("array<string>"))


def models(records: DataFrame, order: list[str]) -> DataFrame:
    """(key, state) for every key and each of its prefixes, from (key, units, seconds)."""
    each = usable(records).select(F.explode(fallback_keys(F.col("key"))).alias("key"), *order, "units", "seconds")
    rows = F.array_sort(F.collect_list(F.struct(*order, "units", "seconds")))
    return each.groupBy("key").agg(rows.alias("rows")).select("key", fitted(F.transform("rows", lambda r: F.struct(r["units"].alias("units"), r["seconds"].alias("seconds")))).alias("state"))


def estimates(asked: DataFrame, known: DataFrame) -> DataFrame:
    """asked: id, key, units -> (id, seconds): the narrowest prefix with three records, else the narrowest with any."""
    each = asked.select("id", "units", F.posexplode(fallback_keys(F.col("key"))).alias("at", "key")).join(known, "key")
    choice = F.struct(F.when(F.col("state.seen") >= LEAST_FIT, 0).otherwise(1), "at")
    picked = each.groupBy("id").agg(F.min_by(F.struct("state", "units"), choice).alias("c"))
    return asked.select("id").join(picked.select("id", predicted(F.col("c.state"), F.col("c.units")).alias("seconds")), "id", "left")


def remaining(stages: Column, now: Column) -> Column:
    """Seconds left over array<struct<took,estimate,started>>: what runs counts down to 0; unknown if any estimate is."""
    def left(s):
        return F.when(s["took"].isNotNull(), 0.0).when(s["started"].isNotNull(), F.greatest(s["estimate"] - (now - s["started"]), F.when(s["estimate"].isNotNull(), 0.0)) + s["estimate"] * 0).otherwise(s["estimate"])

    return F.aggregate(F.transform(stages, left), F.lit(0.0), lambda a, x: a + x)


def ewma_stream(events: DataFrame, key: str, keep: float = KEEP, take: float = TAKE) -> DataFrame:
    """Running average per key on a stream of (key, ts, id, value) in order of (ts, id) within each trigger; state is
    one number and one count a key."""

    def update(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        average, n = state.get if state.exists else (None, 0)
        for v in pd.concat(list(batches)).sort_values(["ts", "id"])["value"].dropna():
            average, n = (float(v) if average is None else keep * average + take * float(v)), n + 1
        if average is not None:
            state.update((average, n))
            yield pd.DataFrame({key: [k[0]], "records": [n], "average": [average]})

    return events.groupBy(key).applyInPandasWithState(update, f"{key} string, records long, average double", "average double, n long", "update", "NoTimeout")


def stage_base(key: Column) -> Column:
    """What a stage is called by: two parts of a judge's key, one of any other."""
    return F.when(key.startswith("judge:"), F.substring_index(key, ":", 2)).otherwise(F.substring_index(key, ":", 1))
