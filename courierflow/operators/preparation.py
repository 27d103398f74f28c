"""Imputation, scaling and encoding, fitted once on training rows.

Fitting reads one row of statistics; transforming is a projection of literals,
so it pushes through the scan and shuffles nothing.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courierflow import domain as D


def median(column: str, exact: bool = True) -> Column:
    """Median of the given values, exact or from a bounded sketch."""
    middle = F.median(column) if exact else F.percentile_approx(column, 0.5, 10000)
    return middle.cast("double")


def most_frequent(column: str) -> Column:
    """Most frequent known level, the smallest of equals.

    Values outside the domain do not count, so the counters stay a handful.
    """
    levels = {**D.CATEGORY_DOMAINS, **D.ORDINAL_DOMAINS}[column]
    return F.mode(F.when(F.col(column).isin(levels), F.col(column)), True)


def fit_scales(
    train: DataFrame, columns: list[str], fill: dict[str, float]
) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column after filling; zero deviation counts as 1."""
    filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(fill[c])) for c in columns}
    row = train.agg(
        *[F.struct(F.avg(v).alias("m"), F.stddev_pop(v).alias("s")).alias(c) for c, v in filled.items()]
    ).first()
    return {c: (row[c]["m"], row[c]["s"] or 1.0) for c in columns}


def _number(value: float) -> str:
    return f"{float(value)!r}D"


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def ordinal_sql(value: str, levels: list[str]) -> str:
    """Position of the value in ``levels``; a value outside them is an error."""
    cases = " ".join(f"when {value} = {_text(lvl)} then {i}D" for i, lvl in enumerate(levels))
    unknown = f"cast(raise_error(concat('unknown level: ', {value})) as double)"
    return f"case {cases} when {value} is not null then {unknown} end"


def one_hot_sql(column: str, value: str, levels: list[str]) -> dict[str, str]:
    """One 0/1 column per level; an unknown value gives all zeros."""
    return {
        f"{column}_{level.lower()}": f"cast(coalesce({value} = {_text(level)}, false) as double)"
        for level in levels
    }


@dataclass(frozen=True)
class Preparation:
    """Fitted statistics of the numeric, ordinal and nominal columns."""

    numeric: list[str]
    ordinal: list[str]
    nominal: list[str]
    binary: list[str]
    medians: dict[str, float] = field(default_factory=dict)
    modes: dict[str, str] = field(default_factory=dict)
    scales: dict[str, tuple[float, float]] = field(default_factory=dict)
    levels: dict[str, list[str]] = field(default_factory=dict)

    def impute(self, df: DataFrame) -> DataFrame:
        """Fill numbers with the training median and categories with the training mode."""
        fills = {**self.medians, **self.modes}
        return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in fills.items()})

    def matrix_sql(self) -> dict[str, str]:
        """Model matrix as named SQL expressions in the fixed column order."""
        out: dict[str, str] = {}
        for c in self.numeric:
            mean, std = self.scales[c]
            filled = f"coalesce(cast({c} as double), {_number(self.medians[c])})"
            out[f"{c}_scaled"] = f"({filled} - {_number(mean)}) / {_number(std)}"
        for c in self.ordinal:
            filled = f"coalesce({c}, {_text(self.modes[c])})"
            out[f"{c}_code"] = ordinal_sql(filled, D.ORDINAL_DOMAINS[c])
        for c in self.nominal:
            filled = f"coalesce({c}, {_text(self.modes[c])})"
            out.update(one_hot_sql(c, filled, self.levels[c]))
        for c in self.binary:
            out[f"{c}_flag"] = f"cast({c} as double)"
        return out

    def matrix(self, df: DataFrame, *keep: str) -> DataFrame:
        """The kept columns followed by the model matrix; everything else is dropped."""
        return df.selectExpr(*keep, *[f"{sql} as {name}" for name, sql in self.matrix_sql().items()])


def fit_preparation(train: DataFrame, engineered: bool = True, exact: bool = True) -> Preparation:
    """Fit on training rows: 12 features and 21 columns, or 7 features and 16 columns."""
    numeric = D.FULL_NUMERIC_FEATURES if engineered else D.NUMERIC_FEATURES
    ordinals = D.FULL_ORDINAL_FEATURES if engineered else D.ORDINAL_FEATURES
    row = train.agg(
        F.struct(*[median(c, exact).alias(c) for c in numeric]).alias("medians"),
        F.struct(*[most_frequent(c).alias(c) for c in ordinals + D.NOMINAL_FEATURES]).alias("modes"),
    ).first()
    medians = row["medians"].asDict()
    return Preparation(
        numeric=numeric,
        ordinal=ordinals,
        nominal=D.NOMINAL_FEATURES,
        binary=D.BINARY_FEATURES if engineered else [],
        medians=medians,
        modes=row["modes"].asDict(),
        scales=fit_scales(train, numeric, medians),
        levels={c: sorted(D.CATEGORY_DOMAINS[c]) for c in D.NOMINAL_FEATURES},
    )
