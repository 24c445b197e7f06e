"""What-if scenarios (H01-H06) and the scenario model.

A scenario is a set of multipliers (price, discount, inflation,
temperature).  Many scenarios run in one job: the scenario list is a request
parameter, turned into a literal array of structs and ``explode``d on every
baseline row -- a generator in the same stage, no join and no shuffle.
All multiplier rules (clamping, the discount-as-percentage reading) are
column expressions, so a scenario table column works the same way.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import r6, round_to

# Multiplier bounds.
MIN_MULT, MAX_MULT = 0.1, 10.0
SCENARIO_FIELDS = ("price", "discount", "inflation", "temperature")
SCN_COLS = tuple(f"scn_{f}" for f in SCENARIO_FIELDS)   # exploded column names


def scenario_array(scenarios: Sequence[Mapping[str, object]]) -> Column:
    """Literal array<struct<scenario_id, price, discount, inflation, temperature>>.

    Missing multipliers are null (read as 1.0 by the rules)."""
    structs = []
    for i, s in enumerate(scenarios):
        sid = str(s.get("scenario_id", f"s{i}"))
        fields = [F.lit(sid).alias("scenario_id")]
        for f in SCENARIO_FIELDS:
            v = s.get(f)
            fields.append(F.lit(None if v is None else float(v)).cast("double").alias(f"scn_{f}"))
        structs.append(F.struct(*fields))
    return F.array(*structs)


def with_scenarios(df: DataFrame, scenarios: Sequence[Mapping[str, object]]) -> DataFrame:
    """Every row once per scenario (columns scenario_id + scn_* multipliers)."""
    return (df.withColumn("_s", F.explode(scenario_array(scenarios)))
              .select("*", "_s.*").drop("_s"))


def _clamp(c: Column) -> Column:
    return F.least(F.greatest(F.coalesce(c, F.lit(1.0)), F.lit(MIN_MULT)), F.lit(MAX_MULT))


def discount_multiplier(d: Column) -> Column:
    """A discount in (0, 10] is a multiplier; otherwise it is a fraction off."""
    raw = F.coalesce(d, F.lit(1.0))
    return _clamp(F.when((raw > 0) & (raw <= MAX_MULT), raw).otherwise(1.0 - raw))


def multipliers(df: DataFrame, temperature: bool = True) -> DataFrame:
    """Clamped multiplier columns, their product and the intensity (distance from 1)."""
    m = {"price_mult": _clamp(F.col("scn_price")), "discount_mult": discount_multiplier(F.col("scn_discount")),
         "inflation_mult": _clamp(F.col("scn_inflation"))}
    if temperature:
        m["temperature_mult"] = _clamp(F.col("scn_temperature"))
    x = df.withColumns(m)
    names = list(m)
    combined = F.lit(1.0)
    sq = F.lit(0.0)
    for n in names:
        combined = combined * F.col(n)
        sq = sq + (F.col(n) - 1) * (F.col(n) - 1)
    return x.withColumns({"combined_mult": combined, "intensity": F.sqrt(sq)})


def scenario_apply(base: DataFrame, scenarios: Sequence[Mapping[str, object]],
                   value: str = "total_forecast") -> DataFrame:
    """Scenario value = round(baseline x product of clamped multipliers),
    floor 0; band 12 % .. 18 % growing with the intensity."""
    x = multipliers(with_scenarios(base, scenarios))
    v = F.greatest(F.bround(F.col(value) * F.col("combined_mult"), 0), F.lit(0.0)).cast("long")
    x = x.withColumn("scenario_value", v)
    conf = 0.12 + 0.06 * F.least(F.lit(1.0), F.col("intensity"))
    return x.withColumns({
        "upper": F.bround(F.col("scenario_value") * (1 + conf), 0).cast("long"),
        "lower": F.bround(F.col("scenario_value") * (1 - conf), 0).cast("long"),
        "intensity": r6("intensity"), "combined_mult": r6("combined_mult"),
    }).drop(*SCN_COLS)


def scenario_daily(daily: DataFrame, scenarios: Sequence[Mapping[str, object]],
                   q: str = "order_qty") -> DataFrame:
    """Daily quantity x price x discount x inflation (floor 0) per
    scenario, multipliers kept as columns."""
    x = multipliers(with_scenarios(daily, scenarios), temperature=False)
    return x.withColumns({
        "order_qty_scn": F.greatest(F.col(q) * F.col("combined_mult"), F.lit(0.0)),
        "intensity": r6("intensity"), "combined_mult": r6("combined_mult"),
    }).drop(*SCN_COLS)


def scenario_delta(applied: DataFrame, keys: Sequence[str], base: str = "total_forecast",
                   scn: str = "scenario_value") -> DataFrame:
    """Per scenario and series: mean (2 places), max and min of
    scenario minus baseline."""
    d = F.col(scn) - F.col(base)
    return applied.groupBy("scenario_id", *keys).agg(
        round_to(F.avg(d), 2).alias("avg_delta"), F.max(d).alias("max_delta"), F.min(d).alias("min_delta"))


def scenario_mean_multiplier(base: DataFrame, scenarios: Sequence[Mapping[str, object]],
                             value: str = "total_forecast") -> DataFrame:
    """Fallback -- baseline x mean of the scenario's raw values; bands
    x1.2 / x0.8 truncated."""
    x = with_scenarios(base, scenarios)
    vals = F.array(*[F.col(f) for f in SCN_COLS])
    present = F.filter(vals, lambda v: v.isNotNull())
    mean = F.when(F.size(present) > 0,
                  F.aggregate(present, F.lit(0.0), lambda a, v: a + v) / F.size(present)).otherwise(1.0)
    v = F.bround(F.col(value) * mean, 0).cast("long")
    return (x.withColumn("scenario_value", v)
             .withColumns({"upper": F.floor(F.col("scenario_value") * 1.2).cast("long"),
                           "lower": F.floor(F.col("scenario_value") * 0.8).cast("long")})
             .drop(*SCN_COLS))


def scenario_features(X: DataFrame, scenario: Mapping[str, object]) -> DataFrame:
    """Numeric scenario values multiply the feature column of the same
    name; other values replace it."""
    out = {}
    for f, v in scenario.items():
        if f in X.columns:
            out[f] = F.col(f) * F.lit(float(v)) if isinstance(v, (int, float)) else F.lit(v)
    return X.withColumns(out)


def scenario_units(df: DataFrame) -> DataFrame:
    """Slider units to multipliers (1000 units = 1.0, $100,000 = 1.0,
    20 C = 1.0, $100 = 1.0, 10 % discount = 0.9, promotion / inflation % as
    1 + pct / 100)."""
    return df.withColumns({
        "order_qty": F.col("order_qty_units") / 1000.0,
        "revenue": F.col("revenue_dollars") / 100000.0,
        "temperature": 1 + (F.col("temperature_c") - 20) * 0.01,
        "price": F.col("price_dollars") / 100.0,
        "discount": 1 - F.col("discount_percent") / 100.0,
        "promotion": 1 + F.col("promotion_percent") / 100.0,
        "inflation": 1 + F.col("inflation_percent") / 100.0,
    })


# ------------------------------------------------------------------ scenario model

# Features of the scenario model.
SCN_FEATURES = ["order_year", "order_month", "order_day", "order_day_of_week", "quarter", "is_weekend",
                "month_sin", "month_cos", "dow_sin", "dow_cos", "day_sin", "day_cos",
                "lag_1", "lag_3", "lag_7", "lag_14",
                "rolling_mean_3", "rolling_std_3", "rolling_trend_3",
                "rolling_mean_7", "rolling_std_7", "rolling_trend_7",
                "rolling_mean_14", "rolling_std_14", "rolling_trend_14",
                "price_mult", "discount_mult", "inflation_mult"]


def scenario_training_frame(daily: DataFrame, scenarios, k: Sequence[str], ds: str = "ds",
                            q: str = "order_qty") -> DataFrame:
    """G19 input: scenario-adjusted daily quantities with calendar, cyclical,
    lag (E04) and rolling (E05) features, per (scenario, series)."""
    from . import clean, features as fe
    x = scenario_daily(daily, scenarios, q)
    keys = ["scenario_id"] + list(k)
    x = clean.calendar_features(x, ds).withColumns({"is_weekend": (F.weekday(ds) >= 5).cast("int")})
    x = clean.cyclical_features(x, ds)
    x = fe.series_lags(x, keys, ds, "order_qty_scn")
    return fe.rolling_multi(x, keys, ds, "order_qty_scn")


def training_rows(daily: DataFrame, k: Sequence[str], ds: str = "ds", q: str = "order_qty", min_rows: int = 200,
                  max_rows: int | None = None) -> DataFrame:
    """What the scenario model learns from, per series: the block that ends at
    the last signal and has enough non-zero rows and variance (E18), of it the
    non-zero rows where there are enough (E19), and only of series that vary and
    have enough different values (B20)."""
    from . import features as fe, quality
    keys = list(k)
    x = fe.training_slice(fe.recent_signal_window(daily, keys, ds, q, max_rows), keys, ds, q, min_rows)
    ready = quality.training_ready(x, keys, q).where("ready").select(*[F.col(c).alias(f"_k_{c}") for c in keys])
    return x.join(ready, [x[c].eqNullSafe(ready[f"_k_{c}"]) for c in keys], "left_semi")


def train_scenario(frame: DataFrame, min_rows: int = 20, **gbt):
    """Gradient-boosted trees on the scenario frame (of ``training_rows``),
    split at the 0.8 date quantile; refuses fewer than ``min_rows`` rows."""
    from ..session import cut_lineage
    from .models import split_quantile, train_gbt
    frame = cut_lineage(frame)
    n = frame.count()
    if n < min_rows:
        raise ValueError(f"insufficient samples for scenario training: {n} < {min_rows}")
    x = split_quantile(frame).withColumn("label", F.col("order_qty_scn"))
    model = train_gbt(x.where(F.col("split") == "train"), SCN_FEATURES, **gbt)
    return model, x


def score_scenario(model, daily: DataFrame, scenarios, k: Sequence[str], days: int = 14,
                   ds: str = "ds", q: str = "order_qty") -> DataFrame:
    """Next ``days`` per (scenario, series) scored from the series tail
    (E20) and future calendar features.  The forecast is a whole number, never
    below 0; the band is 1.15 and 0.85 times it, whole as well (half to even).
    A lag or window that is longer than the series is the tail's (E20)."""
    from . import clean, features as fe
    from .joins import future_grid
    from .models import predict
    keys = ["scenario_id"] + list(k)
    x = scenario_daily(daily, scenarios, q)
    tail = fe.tail_features(x.select(*keys, ds, "order_qty_scn", "price_mult", "discount_mult",
                                     "inflation_mult"), keys, ds, "order_qty_scn")
    mult = x.groupBy(*keys).agg(F.max("price_mult").alias("price_mult"),
                                F.max("discount_mult").alias("discount_mult"),
                                F.max("inflation_mult").alias("inflation_mult"))
    grid = future_grid(tail.join(mult, keys), F.date_add("last_date", 1), F.date_add("last_date", days), ds)
    grid = clean.cyclical_features(clean.calendar_features(grid, ds), ds)
    out = predict(model, grid.select(*keys, ds, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)
                                                  for c in SCN_FEATURES]))
    whole = lambda c: F.bround(c, 0).cast("long")
    value = F.greatest(whole(F.col("prediction")), F.lit(0).cast("long"))
    return out.select(*keys, ds, value.alias("forecast"), whole(value * F.lit(1.15)).alias("upper"), whole(value * F.lit(0.85)).alias("lower"))
