"""Tokens, n-grams, vocabularies, TF-IDF and naive Bayes."""

from __future__ import annotations

from pyspark.sql import functions as F

from gazette.functions.text import english_stop_words, word_ngrams, word_tokens
from gazette.operators import evaluation, naive_bayes, splits
from gazette.operators import terms as T
from gazette.plans.base import (
    ARTICLES_SQL,
    RAW_SQL,
    SPLIT_SQL,
    SQL_SPACE_RUN,
    articles,
    f1_sql,
    query,
    raw_articles,
)
from gazette.plans.exploration import rounded

WORD_SQL = r"[\p{L}\p{N}_]{2,}"


def tokens_sql(text: str = "description") -> str:
    return f"regexp_extract_all(lower({text}), '{WORD_SQL}')"


def grams_sql(tokens: str) -> str:
    """Unigrams and bigrams of a token list."""
    return (f"list_concat({tokens}, list_transform(list_zip({tokens}[1:-2], {tokens}[2:]), "
            f"lambda z: z[1] || ' ' || z[2]))")


@query("word_token_counts", f"""WITH {RAW_SQL}
  SELECT term, count(*) AS df, sum(tf)::BIGINT AS total FROM (
    SELECT id, term, count(*) AS tf FROM (SELECT id, unnest({tokens_sql()}) AS term FROM raw)
    GROUP BY id, term) GROUP BY term""")
def word_token_counts(spark, sf_dir):
    counts = T.term_counts(raw_articles(spark, sf_dir), T.TermSettings())
    return T.document_frequency(counts)


BIGRAMS = T.TermSettings(low=1, high=2)


@query("word_bigrams", f"""WITH {ARTICLES_SQL}, tk AS (SELECT id, {tokens_sql()} AS t FROM art)
  SELECT id, term, count(*) AS tf FROM (SELECT id, unnest({grams_sql("t")}) AS term FROM tk)
  GROUP BY id, term""")
def word_bigrams(spark, sf_dir):
    return T.term_counts(articles(spark, sf_dir), BIGRAMS)


@query("stopword_bigrams", lambda: f"""WITH {RAW_SQL}, sw AS (
    SELECT unnest([{", ".join("'" + w.replace("'", "''") + "'" for w in english_stop_words())}]) AS w),
  al AS (SELECT list(w) AS words FROM sw),
  tk AS (SELECT id, list_filter({tokens_sql()}, lambda x: NOT list_contains(words, x)) AS t
    FROM raw, al)
  SELECT id, len(t)::INTEGER AS n_tokens, len({grams_sql("t")})::INTEGER AS n_grams,
    md5(array_to_string({grams_sql("t")}, '|')) AS grams_md5 FROM tk""")
def stopword_bigrams(spark, sf_dir):
    tokens = word_tokens(F.col("description"), english_stop_words())
    rows = raw_articles(spark, sf_dir).select("id", tokens.alias("t"))
    grams = word_ngrams(F.col("t"), 1, 2)
    return rows.select("id", F.size("t").alias("n_tokens"), F.size(grams).alias("n_grams"),
                       F.md5(F.array_join(grams, "|")).alias("grams_md5"))


CHARS = T.TermSettings(analyzer=T.CHAR_WB, low=3, high=5, min_df=0.002)

CHAR_COUNTS_SQL = f"""wd AS (
    SELECT id, w, count(*) AS times FROM (
      SELECT id, unnest(string_split_regex(lower(description), '{SQL_SPACE_RUN}')) AS w FROM src)
    WHERE w <> '' GROUP BY id, w),
  gr AS (SELECT id, times, ' ' || w || ' ' AS p, unnest([3, 4, 5]) AS n FROM wd),
  sp AS (SELECT id, times, p, n, unnest(range(1, length(p) - n + 2)) AS i FROM gr
    WHERE n <= length(p)),
  cc AS (SELECT id, substr(p, i, n) AS term, sum(times)::BIGINT AS tf FROM sp GROUP BY ALL)"""


@query("char_wb_ngrams", f"""WITH {ARTICLES_SQL}, src AS (SELECT id, description FROM art),
  {CHAR_COUNTS_SQL}
  SELECT term, count(*) AS df, sum(tf)::BIGINT AS total FROM cc GROUP BY term""")
def char_wb_ngrams(spark, sf_dir):
    return T.document_frequency(T.term_counts(articles(spark, sf_dir), CHARS))


@query("char_wb_headlines", f"""WITH {ARTICLES_SQL},
  src AS (SELECT id, coalesce(headline, '') AS description FROM art), {CHAR_COUNTS_SQL}
  SELECT id, term, tf FROM cc""")
def char_wb_headlines(spark, sf_dir):
    return T.term_counts(articles(spark, sf_dir).na.fill({"headline": ""}), CHARS, "headline")


# --------------------------------------------------------------------------- vocabulary, TF-IDF
# Learned on the training rows only.

SETTINGS = T.TermSettings(min_df=0.005, max_df=0.9)

COUNTS_SQL = SPLIT_SQL + f""", tc AS (
  SELECT id, split, term, count(*) AS tf FROM (
    SELECT id, split, unnest({tokens_sql()}) AS term FROM spl) GROUP BY id, split, term),
nn AS (SELECT count(*) FILTER (WHERE split = 'train') AS n FROM spl),
voc AS (SELECT term, df, total, ln((1 + n)::DOUBLE / (1 + df)) + 1 AS idf FROM (
    SELECT term, count(*) AS df, sum(tf)::BIGINT AS total FROM tc WHERE split = 'train'
    GROUP BY term), nn
  WHERE df >= CAST(0.005 AS DOUBLE) * n AND df <= CAST(0.9 AS DOUBLE) * n),
w0 AS (SELECT id, split, term, tf, (1 + ln(tf)) * idf AS raw FROM tc JOIN voc USING (term)),
wt AS (SELECT id, split, term, tf, raw / sqrt(sum(raw * raw) OVER (PARTITION BY id)) AS weight
  FROM w0)"""


def _counts(spark, sf_dir, settings=SETTINGS):
    """(split articles, their term counts with the split, the training vocabulary)."""
    rows = splits.with_split(articles(spark, sf_dir))
    counts = T.term_counts(rows, settings)
    with_split = counts.withColumn("split", splits.split_column(F.col("id")))
    train = F.col("split") == splits.TRAIN
    vocabulary = T.fit_vocabulary(with_split.filter(train),
                                  T.document_count(rows.filter(train).select("id")), settings)
    return rows, with_split, vocabulary


@query("vocab_df_limits", f"WITH {COUNTS_SQL} SELECT term, df, total FROM voc")
def vocab_df_limits(spark, sf_dir):
    return _counts(spark, sf_dir)[2].select("term", "df", "total")


@query("idf_values", f"WITH {COUNTS_SQL} SELECT term, round(idf, 6) AS idf FROM voc")
def idf_values(spark, sf_dir):
    return rounded(_counts(spark, sf_dir)[2].select("term", "idf"), "idf")


@query("top_terms", f"""WITH {COUNTS_SQL}
  SELECT term, total FROM voc ORDER BY total DESC, term LIMIT 100""")
def top_terms(spark, sf_dir):
    vocabulary = _counts(spark, sf_dir)[2]
    return vocabulary.select("term", "total").orderBy(F.desc("total"), "term").limit(100)


@query("max_features", f"""WITH {COUNTS_SQL}, lim AS (
    SELECT * FROM voc ORDER BY total DESC, term LIMIT 1000)
  SELECT term, df, total, round(idf, 6) AS idf FROM lim""")
def max_features(spark, sf_dir):
    limited = T.TermSettings(min_df=0.005, max_df=0.9, max_features=1000)
    return rounded(_counts(spark, sf_dir, limited)[2], "idf")


@query("idf_join", f"""WITH {COUNTS_SQL}
  SELECT id, term, tf, round(idf, 6) AS idf FROM tc JOIN voc USING (term)""")
def idf_join(spark, sf_dir):
    _, counts, vocabulary = _counts(spark, sf_dir)
    return rounded(counts.join(vocabulary.select("term", "idf"), "term")
                   .select("id", "term", "tf", "idf"), "idf")


@query("tfidf_weights", f"""WITH {COUNTS_SQL}
  SELECT id, term, round(weight, 6) AS weight FROM wt""")
def tfidf_weights(spark, sf_dir):
    _, counts, vocabulary = _counts(spark, sf_dir)
    weights = T.term_weights(counts.drop("split"), vocabulary, SETTINGS)
    return rounded(weights.select("id", "term", "weight"), "weight")


@query("count_weights", f"""WITH {COUNTS_SQL}
  SELECT id, sum(tf)::DOUBLE AS weight, count(*) AS terms FROM tc JOIN voc USING (term)
  GROUP BY id""")
def count_weights(spark, sf_dir):
    _, counts, vocabulary = _counts(spark, sf_dir)
    raw = T.TermSettings(min_df=0.005, max_df=0.9, tfidf=False)
    weights = T.term_weights(counts.drop("split"), vocabulary, raw)
    return weights.groupBy("id").agg(F.sum("weight").alias("weight"), F.count("*").alias("terms"))


# --------------------------------------------------------------------------- naive Bayes

NB_SQL = COUNTS_SQL + """, su AS (
  SELECT wt.term, sum(CASE WHEN political = 0 THEN weight ELSE 0 END) AS s0,
    sum(CASE WHEN political = 1 THEN weight ELSE 0 END) AS s1
  FROM wt JOIN spl ON spl.id = wt.id WHERE wt.split = 'train' GROUP BY wt.term),
al AS (SELECT count(*) AS v, sum(s0) AS t0, sum(s1) AS t1 FROM su),
nb AS (SELECT term, ln(s0 + 1) - ln(t0 + v) AS lp0, ln(s1 + 1) - ln(t1 + v) AS lp1 FROM su, al),
pr AS (SELECT ln(avg(1 - political)) AS p0, ln(avg(political)) AS p1 FROM spl
  WHERE split = 'train'),
ll AS (SELECT id, sum(weight * lp0) AS l0, sum(weight * lp1) AS l1 FROM wt JOIN nb USING (term)
  GROUP BY id),
jo AS (SELECT spl.id, political AS y_true, coalesce(l0, 0) + p0 AS j0, coalesce(l1, 0) + p1 AS j1
  FROM spl CROSS JOIN pr LEFT JOIN ll ON ll.id = spl.id WHERE split = 'test'),
np AS (SELECT id, y_true, CASE WHEN j1 > j0 THEN 1 ELSE 0 END AS y_pred,
    round(j1 - j0, 6) AS score FROM jo)"""


def _naive_bayes(spark, sf_dir):
    rows, counts, vocabulary = _counts(spark, sf_dir)
    train = rows.filter(F.col("split") == splits.TRAIN).select(
        "id", F.col("political").alias("label"))

    def weights(part):
        chosen = counts.filter(F.col("split") == part).drop("split")
        return T.term_weights(chosen, vocabulary, SETTINGS)

    model = naive_bayes.train(weights(splits.TRAIN), train)
    return rows, weights, model


@query("nb_train", f"""WITH {NB_SQL}
  SELECT term, round(lp0, 6) AS log_prob_0, round(lp1, 6) AS log_prob_1 FROM nb""")
def nb_train(spark, sf_dir):
    return rounded(_naive_bayes(spark, sf_dir)[2].terms, "log_prob_0", "log_prob_1")


@query("nb_priors", f"""WITH {NB_SQL}
  SELECT round(p0, 6) AS prior_0, round(p1, 6) AS prior_1 FROM pr""")
def nb_priors(spark, sf_dir):
    rows = splits.with_split(articles(spark, sf_dir)).filter(F.col("split") == splits.TRAIN)
    return rounded(naive_bayes.log_priors(rows.select("id", F.col("political").alias("label"))),
                   "prior_0", "prior_1")


def nb_predictions(spark, sf_dir):
    rows, weights, model = _naive_bayes(spark, sf_dir)
    test = rows.filter(F.col("split") == splits.TEST).select(
        "id", F.col("political").alias("y_true"))
    return naive_bayes.predict(model, test, weights(splits.TEST))


@query("nb_predict", f"WITH {NB_SQL} SELECT id, y_true, y_pred, score FROM np")
def nb_predict(spark, sf_dir):
    return rounded(nb_predictions(spark, sf_dir), "score").select("id", "y_true", "y_pred", "score")


@query("nb_f1", f"""WITH {NB_SQL}
  SELECT round({f1_sql()}, 6) AS f1, count(*) AS n FROM np""")
def nb_f1(spark, sf_dir):
    return rounded(evaluation.f1_scores(nb_predictions(spark, sf_dir)), "f1").select("f1", "n")
