"""Counts, rates, distributions and association statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from gazette.operators import eda
from gazette.operators.ordering import average_ranks
from gazette.plans.base import ARTICLES_SQL, articles, query, r6
from gazette.plans.cleaning import YEAR_SQL, tokens_sql

VIEW_SQL = ARTICLES_SQL + f""", v AS (
  SELECT id, {YEAR_SQL}::INTEGER AS year, political, domestic,
    {tokens_sql("description")} AS desc_tokens,
    {tokens_sql("coalesce(headline, '')")} AS headline_tokens FROM art)"""


def view(spark, sf_dir):
    return eda.article_view(articles(spark, sf_dir)).select("id", *eda.NUMERIC_COLUMNS)


def rounded(df, *columns):
    return df.withColumns({c: r6(F.col(c)) for c in columns})


@query("label_distribution", f"""WITH {ARTICLES_SQL}
  SELECT political AS label, count(*) AS n,
    round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM art GROUP BY political""")
def label_distribution(spark, sf_dir):
    return rounded(eda.label_distribution(articles(spark, sf_dir), "political"), "share")


@query("class_weights", f"""WITH {ARTICLES_SQL}
  SELECT domestic AS label, count(*) AS n,
    round(sum(count(*)) OVER ()::DOUBLE / count(*) OVER () / count(*), 6) AS weight
  FROM art GROUP BY domestic""")
def class_weights(spark, sf_dir):
    return rounded(eda.class_weights(articles(spark, sf_dir), "domestic"), "weight")


@query("positive_rates", f"""WITH {ARTICLES_SQL}
  SELECT count(*) AS n, round(avg(political), 6) AS political_rate,
    round(avg(domestic), 6) AS domestic_rate FROM art""")
def positive_rates(spark, sf_dir):
    return rounded(eda.positive_rates(articles(spark, sf_dir)), "political_rate", "domestic_rate")


@query("year_stats", f"""WITH {VIEW_SQL}
  SELECT year, count(*) AS n, round(avg(political), 6) AS political_rate,
    round(avg(domestic), 6) AS domestic_rate, round(avg(desc_tokens), 6) AS mean_desc_tokens,
    round(avg(headline_tokens), 6) AS mean_headline_tokens
  FROM v GROUP BY year""")
def year_stats(spark, sf_dir):
    return rounded(eda.year_stats(view(spark, sf_dir)), "political_rate", "domestic_rate",
                   "mean_desc_tokens", "mean_headline_tokens")


@query("describe_tokens", f"WITH {VIEW_SQL} " + " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, count({c}) AS count, round(avg({c}), 6) AS mean,
    round(stddev_samp({c}), 6) AS std, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max,
    quantile_cont({c}::DOUBLE, 0.25) AS p25, quantile_cont({c}::DOUBLE, 0.5) AS p50,
    quantile_cont({c}::DOUBLE, 0.75) AS p75 FROM v""" for c in eda.NUMERIC_COLUMNS))
def describe_tokens(spark, sf_dir):
    return rounded(eda.describe(view(spark, sf_dir)), "mean", "std")


@query("box_stats", f"""WITH {VIEW_SQL},
  q AS (SELECT political, quantile_cont(desc_tokens::DOUBLE, 0.25) AS q1,
    quantile_cont(desc_tokens::DOUBLE, 0.5) AS median,
    quantile_cont(desc_tokens::DOUBLE, 0.75) AS q3 FROM v GROUP BY political)
  SELECT political, q1, median, q3, min(desc_tokens)::DOUBLE AS whisker_low,
    max(desc_tokens)::DOUBLE AS whisker_high
  FROM v JOIN q USING (political)
  WHERE desc_tokens BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)
  GROUP BY political, q1, median, q3""")
def box_stats(spark, sf_dir):
    return eda.box_stats(view(spark, sf_dir), "desc_tokens", "political")


@query("crosstab_counts", f"""WITH {ARTICLES_SQL}
  SELECT political, count(*) FILTER (WHERE domestic = 0) AS domestic_0,
    count(*) FILTER (WHERE domestic = 1) AS domestic_1 FROM art GROUP BY political""")
def crosstab_counts(spark, sf_dir):
    return eda.crosstab_counts(articles(spark, sf_dir), "political", "domestic")


@query("crosstab_rates", f"""WITH {ARTICLES_SQL}
  SELECT political, round(count(*) FILTER (WHERE domestic = 0)::DOUBLE / count(*), 6) AS domestic_0,
    round(count(*) FILTER (WHERE domestic = 1)::DOUBLE / count(*), 6) AS domestic_1
  FROM art GROUP BY political""")
def crosstab_rates(spark, sf_dir):
    return rounded(eda.crosstab_rates(articles(spark, sf_dir), "political", "domestic"),
                   "domestic_0", "domestic_1")


@query("pearson_matrix", f"WITH {VIEW_SQL} " + " UNION ALL ".join(
    f"SELECT '{a}' AS feature, " + ", ".join(
        f"round(corr({a}::DOUBLE, {b}::DOUBLE), 6) AS {b}" for b in eda.NUMERIC_COLUMNS)
    + " FROM v" for a in eda.NUMERIC_COLUMNS))
def pearson_matrix(spark, sf_dir):
    return rounded(eda.pearson_matrix(view(spark, sf_dir)), *eda.NUMERIC_COLUMNS)


def rank_sql(column: str) -> str:
    return (f"rank() OVER (ORDER BY {column}) + (count(*) OVER (PARTITION BY {column}) - 1) / 2.0")


PAIRS = [(a, f) for a in eda.LABELS for f in eda.FEATURES]
RANKED_SQL = VIEW_SQL + ", rk AS (SELECT *, " + ", ".join(
    f"({rank_sql(c)})::DOUBLE AS r_{c}" for c in eda.NUMERIC_COLUMNS) + " FROM v)"


@query("average_ranks", f"""WITH {RANKED_SQL}
  SELECT desc_tokens, count(*) AS n, max(r_desc_tokens) AS avg_rank FROM rk GROUP BY desc_tokens""")
def ranks(spark, sf_dir):
    return average_ranks(view(spark, sf_dir), "desc_tokens")


@query("spearman", f"WITH {RANKED_SQL} " + " UNION ALL ".join(
    f"SELECT '{a}' AS label, '{f}' AS feature, round(corr(r_{a}, r_{f}), 6) AS spearman_r, "
    f"count(*) AS n FROM rk" for a, f in PAIRS))
def spearman(spark, sf_dir):
    return rounded(eda.spearman(view(spark, sf_dir)), "spearman_r")


@query("point_biserial", f"WITH {VIEW_SQL} " + " UNION ALL ".join(
    f"SELECT '{a}' AS label, '{f}' AS feature, "
    f"round(corr({a}::DOUBLE, {f}::DOUBLE), 6) AS pointbiserial_r FROM v" for a, f in PAIRS))
def point_biserial(spark, sf_dir):
    return rounded(eda.point_biserial(view(spark, sf_dir)), "pointbiserial_r")


# P values come from a distribution function SQL lacks: rows are checked, values in the tests.
@query("association_tests")
def association_tests(spark, sf_dir):
    return eda.association_tests(view(spark, sf_dir))


@query("chi2_phi", f"""WITH {ARTICLES_SQL},
  t AS (SELECT count(*)::DOUBLE AS n,
    count(*) FILTER (WHERE political = 0 AND domestic = 0)::DOUBLE AS a,
    count(*) FILTER (WHERE political = 0 AND domestic = 1)::DOUBLE AS b,
    count(*) FILTER (WHERE political = 1 AND domestic = 0)::DOUBLE AS c,
    count(*) FILTER (WHERE political = 1 AND domestic = 1)::DOUBLE AS d FROM art),
  e AS (SELECT n, unnest([a, b, c, d]) AS o,
    unnest([(a+b)*(a+c)/n, (a+b)*(b+d)/n, (c+d)*(a+c)/n, (c+d)*(b+d)/n]) AS e,
    sign(a*d - b*c) AS s FROM t),
  x AS (SELECT n, s, sum(pow(abs(o - e) - least(CAST(0.5 AS DOUBLE), abs(o - e)), 2) / e) AS chi2
    FROM e GROUP BY n, s)
  SELECT round(chi2, 6) AS chi2, 1 AS dof, round(s * sqrt(chi2 / n), 6) AS phi,
    n::BIGINT AS n FROM x""")
def chi2_phi(spark, sf_dir):
    return rounded(eda.chi_square(articles(spark, sf_dir), "political", "domestic").drop("p"),
                   "chi2", "phi")


@query("chi2_p_value")
def chi2_p_value(spark, sf_dir):
    return eda.chi_square(articles(spark, sf_dir), "political", "domestic").select("chi2", "p")
