"""DQ*: data quality and profiling."""

from __future__ import annotations

from pyspark.sql import functions as F

from courierflow import domain as D
from courierflow.catalog.base import query
from courierflow.functions.features import add_features
from courierflow.operators import columns, profiling, quality, selection, splitting
from courierflow.sources.binding import Tables

NUMBERS = [*D.NUMERIC_FEATURES, D.TARGET]

# The split every split-aware oracle uses: md5 bucket of the order id.
SPLIT_SQL = """
select *, case when ('0x' || left(md5(order_id || '|42'), 8))::bigint % 100 < 20
  then 'test' else 'train' end as split
from deliveries
"""


def long_levels(dims: list[str], table: str, keep: str) -> str:
    """SQL: union of (dim, level, kept columns) over the dimensions."""
    return " union all ".join(
        f"select '{d}' as dim, cast({d} as varchar) as level, {keep} from {table}" for d in dims
    )


def per_column(columns_: list[str], body: str, table: str = "deliveries") -> str:
    """SQL: one row per column from a select list written with {c} for the column."""
    return " union all ".join(
        f"select '{c}' as column_name, {body.replace('{c}', c)} from {table}" for c in columns_
    )


def messy_names(t: Tables):
    return t.deliveries.select(
        F.col("order_id").alias("Order Ref"),
        F.col("distance_km").alias("Trip-Distance"),
        F.col("weather").alias("Weather Condition"),
        F.col("traffic_level").alias("Road_Traffic"),
        F.col("time_of_day").alias("TOD"),
        F.col("vehicle_type").alias("Ride Type"),
        F.col("preparation_time_min").alias("Cook Time (mins)"),
        F.col("courier_experience_yrs").alias("Rider Exp."),
        F.col("delivery_time_min").alias("Time Taken"),
        (F.col("distance_km") * 2).alias("dist"),
    )


def stretched(t: Tables):
    """Deliveries with some values pushed out of range."""
    return t.deliveries.withColumns(
        {
            "distance_km": F.col("distance_km") * 6 - 5,
            "preparation_time_min": F.col("preparation_time_min") * 7,
            "courier_experience_yrs": F.col("courier_experience_yrs") * 6,
        }
    )


STRETCHED_SQL = """
select * replace (distance_km * 6 - 5 as distance_km, preparation_time_min * 7 as preparation_time_min,
  courier_experience_yrs * 6 as courier_experience_yrs) from deliveries
"""

VIOLATIONS_SQL = """
select order_id, list_filter([
  case when distance_km <= 0 or distance_km > 100 then 'distance_km_range' end,
  case when distance_km is null then 'distance_km_null' end,
  case when preparation_time_min < 0 or preparation_time_min > 180 then 'preparation_time_min_range' end,
  case when courier_experience_yrs < 0 or courier_experience_yrs > 50 then 'courier_experience_yrs_range' end,
  case when weather is null or weather not in ('Clear','Rainy','Foggy','Snowy','Windy') then 'weather_category' end,
  case when traffic_level is null or traffic_level not in ('Low','Medium','High') then 'traffic_level_category' end,
  case when time_of_day is null or time_of_day not in ('Morning','Afternoon','Evening','Night') then 'time_of_day_category' end,
  case when vehicle_type is null or vehicle_type not in ('Bike','Scooter','Car') then 'vehicle_type_category' end
], lambda x: x is not null) as codes from stretched_rows
"""

RANGE_CHECKS = {
    "distance_positive": lambda: F.col("distance_km") > 0,
    "distance_within_20km": lambda: F.col("distance_km") <= 20,
    "prep_not_negative": lambda: F.col("preparation_time_min") >= 0,
    "experience_not_negative": lambda: F.col("courier_experience_yrs") >= 0,
    "delivery_longer_than_prep": lambda: F.col("delivery_time_min") >= F.col("preparation_time_min"),
    "delivery_within_90min": lambda: F.col("delivery_time_min") <= 90,
}


def split_table(t: Tables):
    return splitting.with_split(t.deliveries)


FEATURED_SQL = """
select *,
  case when distance_km <= 0 then null when distance_km <= 5 then 'Short'
    when distance_km <= 12 then 'Medium' when distance_km > 12 then 'Long' end as distance_category,
  cast(coalesce(time_of_day = 'Evening', false) as int) as is_peak_meal_hour,
  round_even(preparation_time_min / (distance_km + 1e-5) * 100, 0) / 100 as prep_time_per_km,
  cast(coalesce(vehicle_type = 'Bike' and distance_km > 12, false) as int) as bike_long_distance,
  cast(coalesce(weather in ('Snowy','Rainy','Foggy') and traffic_level = 'High', false) as int) as severe_conditions
from deliveries
"""

_STAT_COLUMNS = [
    ("count", "cast(count({c}) as double)"),
    ("mean", "avg({c})"),
    ("std", "stddev_samp({c})"),
    ("median", "quantile_cont({c}, 0.5)"),
    ("iqr", "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)"),
    ("min", "cast(min({c}) as double)"),
    ("q25", "quantile_cont({c}, 0.25)"),
    ("q75", "quantile_cont({c}, 0.75)"),
    ("max", "cast(max({c}) as double)"),
    ("skew", "skewness({c})"),
]
_SPLIT_STATS = " union all ".join(
    "select '{n}' as stat, (select {e} from split_rows where split = 'train') as tr, "
    "(select {e} from split_rows where split = 'test') as te".format(
        n=name, e=expr.replace("{c}", "delivery_time_min")
    )
    for name, expr in _STAT_COLUMNS
)

QUERIES = [
    query(
        "dq1_normalize_columns",
        lambda t: columns.normalize_columns(messy_names(t)),
        """select order_id as "Order Ref", distance_km, weather, traffic_level, time_of_day, vehicle_type,
        preparation_time_min, courier_experience_yrs, delivery_time_min, distance_km * 2 as dist
        from deliveries""",
    ),
    query(
        "dq2_impute_defaults",
        lambda t: columns.impute_defaults(t.deliveries.drop("vehicle_type"))[0].select(
            "order_id", *D.RAW_FEATURES
        ),
        """select order_id, distance_km, coalesce(weather, 'Clear') as weather,
        coalesce(traffic_level, 'Medium') as traffic_level, coalesce(time_of_day, 'Evening') as time_of_day,
        'Scooter' as vehicle_type, preparation_time_min,
        coalesce(courier_experience_yrs, 3.0e0) as courier_experience_yrs from deliveries""",
    ),
    query(
        "dq3_validate_rows",
        lambda t: quality.add_violations(stretched(t)).select(
            "order_id",
            (F.size("violations") == 0).alias("valid"),
            F.array_join("violations", ",").alias("violations"),
        ),
        """select order_id, len(codes) = 0 as valid, array_to_string(codes, ',') as violations
        from violation_rows""",
        stretched_rows=STRETCHED_SQL,
        violation_rows=VIOLATIONS_SQL,
    ),
    query(
        "dq4_violation_summary",
        lambda t: quality.violation_summary(stretched(t)),
        """select violation, count(*) as rows from (select unnest(codes) as violation from violation_rows)
        group by violation""",
        stretched_rows=STRETCHED_SQL,
        violation_rows=VIOLATIONS_SQL,
    ),
    query(
        "dq5_null_counts",
        lambda t: quality.null_counts(t.deliveries, [*D.RAW_FEATURES, D.TARGET]),
        per_column(
            [*D.RAW_FEATURES, D.TARGET],
            "count(*) filter ({c} is null) as null_count, "
            "round(count(*) filter ({c} is null) * 100.0e0 / count(*), 4) as null_pct",
        ),
    ),
    query(
        "dq6_rows_with_nulls",
        lambda t: quality.rows_with_nulls(t.deliveries, D.RAW_FEATURES),
        "select count(*) filter ("
        + " or ".join(f"{c} is null" for c in D.RAW_FEATURES)
        + ") as rows_with_null, count(*) as total_rows from deliveries",
    ),
    query(
        "dq7_column_info",
        lambda t: quality.column_info(t.deliveries, [*D.RAW_FEATURES, D.TARGET]),
        per_column(
            [*D.RAW_FEATURES, D.TARGET],
            "count({c}) as non_null, case lower(any_value(typeof({c}))) when 'varchar' then 'string' "
            "else lower(any_value(typeof({c}))) end as dtype",
        ),
    ),
    query(
        "dq8_duplicate_rows",
        lambda t: quality.duplicate_rows(t.kitchen_queue, ["order_id", "line_no"]),
        """select cast(sum(n - 1) as bigint) as duplicate_rows, count(*) filter (n > 1) as repeated_keys,
        cast(sum(n) as bigint) as total_rows
        from (select count(*) as n from kitchen_queue group by order_id, line_no)""",
    ),
    query(
        "dq9_range_checks",
        lambda t: quality.range_checks(t.deliveries, {k: c() for k, c in RANGE_CHECKS.items()}),
        """select check_name, failed_rows, case when failed_rows = 0 then 'PASS' else 'FAIL' end as verdict from (
        select 'distance_positive' as check_name, count(*) filter (not distance_km > 0) as failed_rows from deliveries
        union all select 'distance_within_20km', count(*) filter (not distance_km <= 20) from deliveries
        union all select 'prep_not_negative', count(*) filter (not preparation_time_min >= 0) from deliveries
        union all select 'experience_not_negative', count(*) filter (not courier_experience_yrs >= 0) from deliveries
        union all select 'delivery_longer_than_prep', count(*) filter (not delivery_time_min >= preparation_time_min) from deliveries
        union all select 'delivery_within_90min', count(*) filter (not delivery_time_min <= 90) from deliveries)""",
    ),
    query(
        "dq10_describe",
        lambda t: profiling.describe_numeric(t.deliveries, NUMBERS),
        per_column(
            NUMBERS,
            "count({c}) as n, round(avg({c}), 6) as mean, round(stddev_samp({c}), 6) as std, "
            "cast(min({c}) as double) as min, round(quantile_cont({c}, 0.25), 6) as q25, "
            "round(quantile_cont({c}, 0.5), 6) as median, round(quantile_cont({c}, 0.75), 6) as q75, "
            "cast(max({c}) as double) as max",
        ),
    ),
    query(
        "dq10_quantiles_off_the_grid",
        lambda t: selection.exact_quantiles(
            t.deliveries.selectExpr("delivery_time_min / distance_km as min_per_km", "preparation_time_min / distance_km as prep_per_km"),
            ["min_per_km", "prep_per_km"],
            [0.25, 0.5, 0.75, 0.99],
        ).select("column_name", "point", F.round("value", 6).alias("value")),
        """select 'min_per_km' as column_name, cast(p as double) as point, round(quantile_cont(min_per_km, [0.25, 0.5, 0.75, 0.99])[i], 6) as value
        from paces, (values (0.25, 1), (0.5, 2), (0.75, 3), (0.99, 4)) as points(p, i) group by p, i
        union all
        select 'prep_per_km', cast(p as double), round(quantile_cont(prep_per_km, [0.25, 0.5, 0.75, 0.99])[i], 6)
        from paces, (values (0.25, 1), (0.5, 2), (0.75, 3), (0.99, 4)) as points(p, i) group by p, i""",
        paces="select delivery_time_min / distance_km as min_per_km, preparation_time_min / distance_km as prep_per_km from deliveries",
    ),
    query(
        "dq11_category_frequency",
        lambda t: profiling.category_frequency(t.deliveries, D.CATEGORY_COLUMNS),
        """select dim, level, count(*) as n,
        round(count(*) * 100.0e0 / sum(count(*)) over (partition by dim), 4) as pct
        from levels group by dim, level""",
        levels=long_levels(D.CATEGORY_COLUMNS, "deliveries", "order_id"),
    ),
    query(
        "dq12_cardinality",
        lambda t: quality.cardinality(t.deliveries, [*D.CATEGORY_COLUMNS, "hotel_id"]),
        per_column(
            [*D.CATEGORY_COLUMNS, "hotel_id"],
            "count(distinct {c}) + max(case when {c} is null then 1 else 0 end) as n_unique",
        ),
    ),
    query(
        "dq13_group_profile",
        lambda t: profiling.group_profile(add_features(t.deliveries), [*D.CATEGORY_COLUMNS, "distance_category"], D.TARGET),
        """select dim, level, count(t) as n, round(avg(t), 4) as mean, round(quantile_cont(t, 0.5), 4) as median,
        round(stddev_samp(t), 4) as std, cast(min(t) as double) as min, cast(max(t) as double) as max
        from levels group by dim, level""",
        featured=FEATURED_SQL,
        levels=long_levels([*D.CATEGORY_COLUMNS, "distance_category"], "featured", "delivery_time_min as t"),
    ),
    query(
        "dq14_correlation_matrix",
        lambda t: profiling.correlation_matrix(t.deliveries, NUMBERS),
        " union all ".join(
            f"select '{a}' as x, '{b}' as y, round(corr({a}, {b}), 6) as r from deliveries"
            for a in NUMBERS
            for b in NUMBERS
        ),
    ),
    query(
        "dq15_outlier_summary",
        lambda t: profiling.outlier_summary(t.deliveries, NUMBERS),
        """select column_name, round(any_value(q1), 4) as q1, round(any_value(q3), 4) as q3,
        round(any_value(q3 - q1), 4) as iqr, round(any_value(q1 - (q3 - q1) * 1.5), 4) as low_fence,
        round(any_value(q3 + (q3 - q1) * 1.5), 4) as high_fence,
        count(*) filter (v < q1 - (q3 - q1) * 1.5 or v > q3 + (q3 - q1) * 1.5) as outliers,
        round(count(*) filter (v < q1 - (q3 - q1) * 1.5 or v > q3 + (q3 - q1) * 1.5) * 100.0e0 / count(*), 4) as outlier_pct
        from vals join quarts using (column_name) group by column_name""",
        vals=per_column(NUMBERS, "cast({c} as double) as v"),
        quarts="select column_name, quantile_cont(v, 0.25) as q1, quantile_cont(v, 0.75) as q3 from vals group by column_name",
    ),
    query(
        "dq16_outlier_rows",
        lambda t: profiling.outlier_rows(t.deliveries, D.TARGET).select("order_id", D.TARGET),
        """select order_id, delivery_time_min from deliveries where delivery_time_min > (
        select quantile_cont(delivery_time_min, 0.75)
          + 1.5 * (quantile_cont(delivery_time_min, 0.75) - quantile_cont(delivery_time_min, 0.25)) from deliveries)""",
    ),
    query(
        "dq17_histogram",
        lambda t: profiling.histogram(t.deliveries, D.TARGET, 25),
        """select bin, round(lo + bin * width, 6) as bin_low, round(lo + (bin + 1) * width, 6) as bin_high, count(*) as n
        from (select cast(least(24, floor((delivery_time_min - lo) / width)) as bigint) as bin, lo, width
          from deliveries, (select cast(min(delivery_time_min) as double) as lo,
            (cast(max(delivery_time_min) as double) - cast(min(delivery_time_min) as double)) / 25.0e0 as width from deliveries)
          where delivery_time_min is not null) group by bin, lo, width""",
    ),
    query(
        "dq18_five_numbers",
        lambda t: profiling.five_numbers(t.deliveries, D.CATEGORY_COLUMNS, D.TARGET),
        """select dim, level, round(quantile_cont(t, 0.0), 4) as min, round(quantile_cont(t, 0.25), 4) as q25,
        round(quantile_cont(t, 0.5), 4) as median, round(quantile_cont(t, 0.75), 4) as q75,
        round(quantile_cont(t, 1.0), 4) as max from levels group by dim, level""",
        levels=long_levels(D.CATEGORY_COLUMNS, "deliveries", "delivery_time_min as t"),
    ),
    query(
        "dq19_linear_trend",
        lambda t: profiling.linear_trend(t.deliveries, D.TARGET, D.NUMERIC_FEATURES),
        per_column(
            D.NUMERIC_FEATURES,
            "round(regr_slope(delivery_time_min, {c}), 6) as slope, "
            "round(regr_intercept(delivery_time_min, {c}), 6) as intercept, "
            "round(regr_r2(delivery_time_min, {c}), 6) as r2",
        ),
    ),
    query(
        "dq20_split_comparison",
        lambda t: profiling.split_comparison(split_table(t), D.TARGET),
        """select stat, round(tr, 4) as train, round(te, 4) as test, round(abs(tr - te), 4) as abs_diff,
        round(abs(tr - te) * 100.0e0 / nullif(tr, 0.0e0), 4) as pct_of_train from split_stats""",
        split_rows=SPLIT_SQL,
        split_stats=_SPLIT_STATS,
    ),
    query(
        "dq21_level_coverage",
        lambda t: profiling.level_coverage(split_table(t), D.CATEGORY_COLUMNS),
        """select dim, level, bool_or(split = 'train') as in_train, bool_or(split = 'test') as in_test,
        case when bool_or(split = 'train') and bool_or(split = 'test') then 'both'
          when bool_or(split = 'train') then 'train_only' else 'test_only' end as seen
        from levels group by dim, level""",
        split_rows=SPLIT_SQL,
        levels=long_levels(D.CATEGORY_COLUMNS, "split_rows", "split"),
    ),
    query(
        "dq22_split_proportions",
        lambda t: profiling.split_proportions(split_table(t), D.CATEGORY_COLUMNS),
        """select dim, level, s.split, round(count(*) filter (levels.split = s.split) * 100.0e0
          / sum(count(*) filter (levels.split = s.split)) over (partition by dim, s.split), 4) as pct
        from levels, (values ('train'), ('test')) as s(split) group by dim, level, s.split""",
        split_rows=SPLIT_SQL,
        levels=long_levels(D.CATEGORY_COLUMNS, "split_rows", "split"),
    ),
    query(
        "dq23_leakage_audit",
        lambda t: profiling.leakage_audit(split_table(t), "order_id", D.TARGET, D.ALL_FEATURES),
        """select 'splits_share_no_id' as check_name,
          (select count(*) from (select order_id from split_rows where split = 'train'
            intersect select order_id from split_rows where split = 'test')) = 0 as passed
        union all select 'every_id_once', (select count(*) = count(distinct order_id) from split_rows)
        union all select 'target_not_in_features', true union all select 'id_not_in_features', true
        union all select 'twelve_features', true""",
        split_rows=SPLIT_SQL,
    ),
    query(
        "dq24_feature_signal",
        lambda t: profiling.feature_signal(add_features(t.deliveries), D.BINARY_FEATURES, D.TARGET),
        """select dim, level, count(t) as n, round(avg(t), 4) as mean, round(stddev_samp(t), 4) as std,
        round(any_value(r), 6) as corr_with_target from levels join (
          select dim as d2, corr(f, t) as r from levels group by dim) on dim = d2 group by dim, level""",
        featured=FEATURED_SQL,
        levels=" union all ".join(
            f"select '{f}' as dim, cast({f} as varchar) as level, {f} as f, delivery_time_min as t from featured"
            for f in D.BINARY_FEATURES
        ),
    ),
]
