"""Per-entity time-series features.

`transform` adds lags, differences and rolling statistics to every row: one
window specification, so one shuffle by entity. `aggregate_to_entity` gives a row
for each entity with statistics of calendar windows before its last row, and
"calculus" features of them: conditional aggregates in one grouping instead of a
filter, a grouping and a join for each window.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import TimeSeriesConfig

NUMERIC = (T.FloatType, T.DoubleType, T.IntegerType, T.LongType)
DAY_MICROS = 86_400_000_000
#: Keeps ratios of window statistics finite.
RATIO_EPS = 0.001


def numeric_columns(df: DataFrame, skip: set[str]) -> list[str]:
    return [f.name for f in df.schema.fields if f.name not in skip and isinstance(f.dataType, NUMERIC)]


def whole_days(later: Column, earlier: Column) -> Column:
    """Full 24-hour days between two times, not calendar days."""
    return F.floor((F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / DAY_MICROS).cast("int")


class TimeSeries:
    def __init__(self, config: TimeSeriesConfig | None = None):
        self.config = config or TimeSeriesConfig()

    @property
    def order(self) -> list[str]:
        return [self.config.time_col, *self.config.tiebreak]

    def _skip(self) -> set[str]:
        return {self.config.group_col, self.config.time_col, *self.config.tiebreak}

    def transform(self, df: DataFrame) -> DataFrame:
        cfg = self.config
        columns = cfg.feature_cols or numeric_columns(df, self._skip())[: cfg.max_cols]
        w = Window.partitionBy(cfg.group_col).orderBy(*self.order)
        made: dict[str, Column] = {}
        for c in columns:
            made |= {f"{c}_lag{k}": F.lag(c, k).over(w) for k in cfg.lags}
            made |= {f"{c}_diff{k}": F.col(c) - F.lag(c, k).over(w) for k in cfg.differentials}
            for k in cfg.rolling_windows:
                frame = w.rowsBetween(-(k - 1), 0)
                full = F.count(c).over(frame) == k
                made[f"{c}_rmean{k}"] = F.when(full, F.avg(c).over(frame))
                made[f"{c}_rstd{k}"] = F.when(full, F.stddev_samp(c).over(frame))
        return df.select("*", *[v.alias(k) for k, v in made.items()])

    def days_before(self, df: DataFrame, output: str = "days_before") -> DataFrame:
        """Whole days before the entity's last time; a window maximum, no self-join."""
        last = F.max(self.config.time_col).over(Window.partitionBy(self.config.group_col))
        return df.withColumn(output, whole_days(last, F.col(self.config.time_col)))

    def window_stats(self, df: DataFrame, columns: list[str] | None = None) -> DataFrame:
        """{c}_w{w}_{mean,std,sum,min,max,last,first,cnt} for each column and window."""
        cfg = self.config
        columns = columns or numeric_columns(df, self._skip())[: cfg.max_cols]
        rows = self.days_before(df, "__days")
        at = F.struct(*self.order)
        aggs = []
        for w in cfg.windows:
            inside = F.col("__days") <= w
            for c in columns:
                v = F.when(inside, F.col(c))
                when = F.when(inside, at)
                name = f"{c}_w{w}_"
                aggs += [F.avg(v).alias(name + "mean"), F.stddev_samp(v).alias(name + "std"), F.sum(v).alias(name + "sum"), F.min(v).alias(name + "min"), F.max(v).alias(name + "max"), F.max_by(F.col(c), when).alias(name + "last"), F.min_by(F.col(c), when).alias(name + "first"), F.count(v).alias(name + "cnt")]
        return rows.groupBy(cfg.group_col).agg(*aggs)

    def calculus(self, stats: DataFrame, columns: list[str]) -> DataFrame:
        """Velocity, acceleration, momentum, integral, extrapolation, volatility,
        trend and range of the short, middle and long windows."""
        windows = self.config.windows
        short, long = windows[0], windows[-1]
        mid = windows[2] if len(windows) > 2 else 30
        if mid not in windows:
            raise ValueError("with fewer than three windows, 30 must be among them")
        made: dict[str, Column] = {}
        for c in columns:

            def s(w: int, name: str, c: str = c) -> Column:
                return F.col(f"{c}_w{w}_{name}").cast("double")

            def over(a: Column, span: int) -> Column:
                # Windows of equal width have no slope between them.
                return a / float(span) if span else F.lit(0.0)

            velocity = {w: over(s(w, "last") - s(w, "first"), w) for w in (short, mid, long)}
            accel_short, accel_long = over(velocity[short] - velocity[mid], mid - short), over(velocity[mid] - velocity[long], long - mid)
            made |= {f"{c}_velocity_{w}": v for w, v in velocity.items()}
            made |= {f"{c}_accel_short": accel_short, f"{c}_accel_long": accel_long, f"{c}_momentum": accel_short - accel_long}
            made |= {f"{c}_integral_{w}": s(w, "sum") for w in (mid, long)}
            made |= {f"{c}_predict_{h}d": s(short, "last") + velocity[short] * h for h in (7, 30)}
            made[f"{c}_vol_ratio_{short}vs{long}"] = s(short, "std") / (s(long, "std") + RATIO_EPS)
            made[f"{c}_trend_{short}vs{long}"] = s(short, "mean") / (s(long, "mean") + RATIO_EPS)
            made |= {f"{c}_range_{w}": s(w, "max") - s(w, "min") for w in (short, mid)}
        return stats.select("*", *[v.alias(k) for k, v in made.items()])

    def aggregate_to_entity(self, df: DataFrame, target: DataFrame | None = None, target_col: str = "target") -> DataFrame:
        columns = numeric_columns(df, self._skip())[: self.config.max_cols]
        out = self.window_stats(df, columns)
        if self.config.enable_calculus:
            out = self.calculus(out, columns)
        out = out.fillna(0)
        if target is not None:
            out = out.join(target.select(self.config.group_col, target_col), self.config.group_col)
        return out


def calculus_features(df: DataFrame, config: TimeSeriesConfig, target: DataFrame | None = None, target_col: str = "target") -> DataFrame:
    """Transform, then aggregate the transformed rows (to ``max_cols`` columns)."""
    ts = TimeSeries(config)
    return ts.aggregate_to_entity(ts.transform(df), target, target_col)


def differential_features(df: DataFrame, config: TimeSeriesConfig) -> DataFrame:
    return TimeSeries(replace(config, rolling_windows=[], enable_calculus=False)).transform(df)
