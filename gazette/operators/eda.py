"""Exploratory statistics of the article table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gazette.functions import labels as L
from gazette.functions.significance import chi_square_p_value, correlation_p_value
from gazette.functions.text import token_count
from gazette.operators.ordering import (
    exact_quantiles,
    join_groups,
    quantiles_of_counts,
    ranks_of_counts,
    value_counts,
)
from gazette.shipping import ship_package
from gazette.sources.scratch import written

# The numeric columns looked at, and the whisker length of a box plot.
NUMERIC_COLUMNS = ("year", "political", "domestic", "desc_tokens", "headline_tokens")
LABELS = ("political", "domestic")
FEATURES = ("year", "desc_tokens", "headline_tokens")
WHISKER = 1.5
PREVIEW_COLUMNS = ("id", "year", "headline", "political", "domestic", "desc_tokens",
                   "headline_tokens")


def article_view(df: DataFrame) -> DataFrame:
    """Date, numeric year, token counts and their logs. Articles keep unreadable dates."""
    date = L.parse_day_first(F.col("date"))
    return df.withColumns({
        "date_dt": date,
        "year": F.coalesce(F.year(date), F.lit(L.NO_YEAR)),
        "desc_tokens": token_count(L.text_or_empty(F.col("description"))),
        "headline_tokens": token_count(L.text_or_empty(F.col("headline"))),
    }).withColumns({
        "desc_tokens_log1p": F.log1p("desc_tokens"),
        "headline_tokens_log1p": F.log1p("headline_tokens"),
    })


def date_check(df: DataFrame) -> DataFrame:
    """Rows and unreadable dates."""
    bad = L.parse_day_first(F.col("date")).isNull()
    return df.agg(F.count("*").alias("n"), F.count_if(bad).alias("unreadable"))


def require_dates(df: DataFrame) -> DataFrame:
    """The same rows; the job fails on the first date that cannot be read."""
    bad = L.parse_day_first(F.col("date")).isNull()
    checked = F.when(bad, F.raise_error(F.lit("some dates failed to parse")).cast("string"))
    return df.withColumn("date", checked.otherwise(F.col("date")))


def preview(df: DataFrame, rows: int = 3) -> DataFrame:
    return df.select(*PREVIEW_COLUMNS).orderBy("id").limit(rows)


def positive_rates(df: DataFrame, labels: Sequence[str] = LABELS) -> DataFrame:
    return df.agg(F.count("*").alias("n"), *[F.avg(c).alias(f"{c}_rate") for c in labels])


def _class_counts(df: DataFrame, label: str) -> DataFrame:
    """``label, n, rows, classes``: one scan, then a window over one row per class."""
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    whole = W.partitionBy(F.lit(0))
    return counts.withColumns({"rows": F.sum("n").over(whole),
                               "classes": F.count("*").over(whole)})


def label_distribution(df: DataFrame, label: str) -> DataFrame:
    """``label, n, share``."""
    return _class_counts(df, label).select("label", "n", (F.col("n") / F.col("rows"))
                                           .alias("share"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weights: rows / (classes x rows of the class)."""
    weight = F.col("rows") / F.col("classes") / F.col("n")
    return _class_counts(df, label).select("label", "n", weight.alias("weight"))


def year_stats(view: DataFrame) -> DataFrame:
    return view.groupBy("year").agg(
        F.count("*").alias("n"),
        F.avg("political").alias("political_rate"),
        F.avg("domestic").alias("domestic_rate"),
        F.avg("desc_tokens").alias("mean_desc_tokens"),
        F.avg("headline_tokens").alias("mean_headline_tokens"),
    ).orderBy("year")


def _long(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """``keep..., feature, value`` with one row per column: one scan for all columns."""
    cells = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"))
             for c in columns]
    return df.select(*keep, F.explode(F.array(*cells)).alias("cell")).select(*keep, "cell.*")


def describe(view: DataFrame, columns: Sequence[str] = NUMERIC_COLUMNS) -> DataFrame:
    """count, mean, std, min, quartiles and max per column."""
    long = _long(view, columns)
    basics = long.groupBy("feature").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
        F.max("value").alias("max"))
    quartiles = exact_quantiles(long, "value", {"p25": 0.25, "p50": 0.5, "p75": 0.75}, ["feature"])
    # A column without values has a count of 0 and no quartiles.
    return basics.join(quartiles, "feature", "left")


def box_stats(view: DataFrame, value: str, label: str) -> DataFrame:
    """Quartiles per label and whiskers: the outermost values within 1.5 box lengths."""
    counted = written(value_counts(view, value, [label]), "value-counts")
    shares = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    quartiles = quantiles_of_counts(counted, value, shares, [label])
    reach = (F.col("q3") - F.col("q1")) * WHISKER
    inside = (F.col(value) >= F.col("q1") - reach) & (F.col(value) <= F.col("q3") + reach)
    return join_groups(counted, quartiles, [label]).filter(inside).groupBy(
        label, "q1", "median", "q3").agg(
        F.min(value).cast("double").alias("whisker_low"),
        F.max(value).cast("double").alias("whisker_high"))


def crosstab_counts(df: DataFrame, rows: str, columns: str, values: Sequence[int] = (0, 1)
                    ) -> DataFrame:
    """Counts of ``columns`` values (as columns) per ``rows`` value."""
    return df.groupBy(rows).agg(
        *[F.count_if(F.col(columns) == v).alias(f"{columns}_{v}") for v in values])


def crosstab_rates(df: DataFrame, rows: str, columns: str, values: Sequence[int] = (0, 1)
                   ) -> DataFrame:
    """The same, as shares of each row."""
    counts = crosstab_counts(df, rows, columns, values)
    names = [f"{columns}_{v}" for v in values]
    whole = sum((F.col(n) for n in names[1:]), F.col(names[0]))
    return counts.select(rows, *[F.try_divide(F.col(n).cast("double"), whole).alias(n)
                                 for n in names])


def pearson_matrix(view: DataFrame, columns: Sequence[str] = NUMERIC_COLUMNS) -> DataFrame:
    """``feature`` and one column per feature, all pairs from one aggregate."""
    pairs = {f"{a}|{b}": F.corr(a, b) for i, a in enumerate(columns) for b in columns[i:]}
    row = view.agg(*[c.alias(name) for name, c in pairs.items()])

    def cell(a: str, b: str):
        name = f"{a}|{b}" if f"{a}|{b}" in pairs else f"{b}|{a}"
        return F.col(f"`{name}`")

    lines = [F.struct(F.lit(a).alias("feature"), *[cell(a, b).alias(b) for b in columns])
             for a in columns]
    return row.select(F.explode(F.array(*lines)).alias("line")).select("line.*")


def _label_feature_pairs(view: DataFrame, labels: Sequence[str], features: Sequence[str]
                         ) -> DataFrame:
    """``label, feature, y, x, n``: counts of value pairs, the data once and then small."""
    cells = [F.struct(F.lit(a).alias("label"), F.lit(f).alias("feature"),
                      F.col(a).cast("double").alias("y"), F.col(f).cast("double").alias("x"))
             for a in labels for f in features]
    return (view.select(F.explode(F.array(*cells)).alias("cell")).select("cell.*")
            .groupBy("label", "feature", "y", "x").agg(F.count("*").alias("n")))


def _weighted_corr(x, y, n):
    """Pearson correlation of counted, centred pairs."""
    return F.try_divide(F.sum(n * x * y), F.sqrt(F.sum(n * x * x)) * F.sqrt(F.sum(n * y * y)))


def spearman(view: DataFrame, labels: Sequence[str] = LABELS, features: Sequence[str] = FEATURES
             ) -> DataFrame:
    """Rank correlation of every label with every feature, ties at their mean rank."""
    by = ["label", "feature"]
    pairs = written(_label_feature_pairs(view, labels, features), "value-pairs")

    def ranks(value: str, name: str) -> DataFrame:
        # Ranks of a value from the counts of all smaller values.
        spread = pairs.groupBy(*by, value).agg(F.sum("n").alias("n"))
        return ranks_of_counts(spread, value, by).select(
            *by, value, F.col("avg_rank").alias(name))

    ranked = pairs.join(ranks("x", "rx"), [*by, "x"]).join(ranks("y", "ry"), [*by, "y"])
    sizes = pairs.groupBy(*by).agg(F.sum("n").alias("rows"))
    centred = ranked.join(sizes, by)
    middle = (F.col("rows") + 1) / F.lit(2.0)
    return centred.groupBy(*by).agg(
        _weighted_corr(F.col("rx") - middle, F.col("ry") - middle, F.col("n")).alias("spearman_r"),
        F.max("rows").alias("n"))


def point_biserial(view: DataFrame, labels: Sequence[str] = LABELS,
                   features: Sequence[str] = FEATURES) -> DataFrame:
    """Pearson correlation of every label with every feature, one pass."""
    wide = view.agg(*[F.corr(F.col(a).cast("double"), F.col(f).cast("double")).alias(f"{a}|{f}")
                      for a in labels for f in features])
    cells = [F.struct(F.lit(a).alias("label"), F.lit(f).alias("feature"),
                      F.col(f"`{a}|{f}`").alias("pointbiserial_r"))
             for a in labels for f in features]
    return wide.select(F.explode(F.array(*cells)).alias("cell")).select("cell.*")


def association_tests(view: DataFrame) -> DataFrame:
    """Both correlations with p values per label and feature, strongest first within a label."""
    ship_package(view.sparkSession)
    r = point_biserial(view).join(spearman(view), ["label", "feature"])
    n = F.col("n").cast("double")
    return r.select(
        "label", "feature", "pointbiserial_r",
        correlation_p_value("pointbiserial_r", n).alias("pointbiserial_p"),
        "spearman_r", correlation_p_value("spearman_r", n).alias("spearman_p"),
        F.abs("pointbiserial_r").alias("abs_pointbiserial_r"),
    ).orderBy("label", F.desc("abs_pointbiserial_r"))


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """``chi2, dof, p, phi, n`` of two labels; Yates' correction when the table is 2 x 2.

    One pass counts the pairs of values. All the rest, the grid of expected counts included,
    has classes x classes rows.
    """
    ship_package(df.sparkSession)
    cells = written(df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
                    .groupBy(F.col(a).alias("a"), F.col(b).alias("b"))
                    .agg(F.count("*").alias("o")), "crosstab")
    rows = cells.groupBy("a").agg(F.sum("o").alias("row_n"))
    columns = cells.groupBy("b").agg(F.sum("o").alias("col_n"))
    n, x, y = F.sum("o").cast("double"), F.col("a").cast("double"), F.col("b").cast("double")
    covariance = n * F.sum(F.col("o") * x * y) - F.sum(F.col("o") * x) * F.sum(F.col("o") * y)
    whole = cells.agg(
        F.sum("o").alias("n"), F.signum(covariance).alias("sign"),
        ((F.countDistinct("a") - 1) * (F.countDistinct("b") - 1)).alias("dof"))
    n, sign, dof = (whole.select(c).scalar() for c in ("n", "sign", "dof"))
    # Every row value meets every column value, also where no pair was counted.
    grid = (rows.select("a", "row_n", F.explode(_collected(columns, "b", "col_n")).alias("c"))
            .select("a", "row_n", F.col("c.b").alias("b"), F.col("c.col_n").alias("col_n")))
    filled = grid.join(cells, ["a", "b"], "left")
    expected = F.col("row_n").cast("double") * F.col("col_n") / n
    gap = F.abs(F.coalesce("o", F.lit(0)) - expected)
    shift = F.when(dof == 1, F.least(F.lit(0.5), gap)).otherwise(F.lit(0.0))
    result = filled.agg(F.sum((gap - shift) * (gap - shift) / expected).alias("chi2"))
    return result.select(
        "chi2", dof.cast("int").alias("dof"),
        chi_square_p_value("chi2", dof.cast("double")).alias("p"),
        (sign * F.sqrt(F.col("chi2") / n)).alias("phi"),
        n.alias("n"))


def _collected(df: DataFrame, *columns: str):
    """The rows of a classes-sized table as one array value."""
    return df.agg(F.collect_list(F.struct(*columns))).scalar()


def null_profile(df: DataFrame) -> DataFrame:
    """``column, type, nulls, n`` per column from one pass."""
    counts = df.agg(F.count("*").alias("_n"),
                    *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    lines = [F.struct(F.lit(name).alias("column"), F.lit(kind).alias("type"),
                      F.col(name).alias("nulls"), F.col("_n").alias("n"))
             for name, kind in df.dtypes]
    return counts.select(F.explode(F.array(*lines)).alias("line")).select("line.*")


def label_domain(df: DataFrame, labels: Sequence[str] = LABELS) -> DataFrame:
    """How often every raw label value occurs, to show values outside 0 and 1."""
    cells = [F.struct(F.lit(c).alias("label"), F.col(c).cast(T.StringType()).alias("value"))
             for c in labels]
    return (df.select(F.explode(F.array(*cells)).alias("cell")).select("cell.*")
            .groupBy("label", "value").agg(F.count("*").alias("n")))
