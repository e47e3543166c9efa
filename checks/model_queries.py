"""Modelling plan, folds, scores, explanations and the scorecard."""

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tablewright.operators import explanation, modelling
from tablewright.operators.profile import Profile
from tablewright.plans.analyses import dataset_scorecard
from tablewright.session import cut_lineage

from .health_queries import GRADE_SQL, SCORE_SQL, issues_cte
from .relations import EVENTS, LABELS, LINEITEM, MESSY, ORDERS, PLANTED, Relation, profile_cte, query

PROBLEM = (
    "CASE WHEN semantic_type = 'binary' THEN 'binary_classification' WHEN semantic_type = 'numeric_continuous' THEN 'regression' "
    "WHEN semantic_type = 'categorical' THEN 'multiclass_classification' WHEN semantic_type = 'numeric_discrete' AND n_unique <= 15 "
    "THEN 'multiclass_classification' WHEN semantic_type = 'numeric_discrete' THEN 'regression' ELSE 'unknown' END"
)


@query("problem_types", f'WITH {profile_cte(MESSY)} SELECT position, col AS "column", {PROBLEM} AS problem_type FROM profile')
def problem_types(spark, sf_dir):
    return modelling.problem_types(Profile.of(MESSY.read(spark, sf_dir)).frame)


SELECTION = """SELECT position, col AS "column", reason IS NULL AS used, reason,
CASE WHEN reason IS NULL AND semantic_type IN ('numeric_continuous', 'numeric_discrete') THEN 'numeric'
WHEN reason IS NULL AND semantic_type IN ('categorical', 'binary') THEN 'categorical' END AS role
FROM (SELECT *, CASE WHEN semantic_type IN ('identifier', 'constant', 'text', 'unknown') THEN semantic_type
WHEN missing_pct > 60.0 THEN 'mostly_missing' END AS reason FROM profile) WHERE col <> '{target}'"""


@query("feature_selection", f"WITH {profile_cte(MESSY)} {SELECTION.format(target='l_linestatus')}")
def feature_selection(spark, sf_dir):
    return modelling.feature_selection(Profile.of(MESSY.read(spark, sf_dir)).frame, "l_linestatus")


@query("feature_roles", f"""WITH {profile_cte(EVENTS)} SELECT "column", role FROM ({SELECTION.format(target='event_type')}) WHERE used""")
def feature_roles(spark, sf_dir):
    found = modelling.feature_selection(Profile.of(EVENTS.read(spark, sf_dir)).frame, "event_type")
    return found.where("used").select("column", "role")


@query(
    "target_balance",
    """SELECT 'mostly' AS "column", round(max(n)::DOUBLE / sum(n), 6) AS top_share,
CASE WHEN max(n)::DOUBLE / sum(n) >= 0.7 THEN 'f1' ELSE 'accuracy' END AS primary_metric,
max(n)::DOUBLE / sum(n) >= 0.9 AS severe_imbalance FROM (SELECT mostly, count(*) AS n FROM """ + PLANTED.sql + " GROUP BY mostly)",
)
def target_balance(spark, sf_dir):
    found = modelling.target_balance(Profile.of(PLANTED.read(spark, sf_dir)).frame, "mostly")
    return found.withColumn("top_share", F.round("top_share", 6))


@query(
    "data_warnings",
    f"""WITH {profile_cte(MESSY)} SELECT 'target_gaps' AS warning, missing_pct::DOUBLE AS value FROM profile WHERE col = 'gap'""",
)
def data_warnings(spark, sf_dir):
    return modelling.data_warnings(Profile.of(MESSY.read(spark, sf_dir)).frame, "gap")


# ---- a classification frame: quality of documents ------------------------------------------


def quality_frame(spark, sf_dir):
    """labels joined to what is known about the documents, written down once: the many scans of an experiment read no text again."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id", "lang", "n_chars", (F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit("")))).alias("n_spaces")
    )
    return cut_lineage(LABELS.read(spark, sf_dir).join(documents, "doc_id").drop("doc_id"))


def quality_experiment(spark, sf_dir) -> modelling.Experiment:
    return modelling.run_experiment(quality_frame(spark, sf_dir), "quality").complete()


def price_experiment(spark, sf_dir, models: list[str] | None = None) -> modelling.Experiment:
    """Net price of every line item; `models` where a query looks at no others."""
    return modelling.run_experiment(PLANTED.read(spark, sf_dir), "net", models=models).complete()


def fitted(spark, sf_dir, which: str, model: str):
    experiment = quality_experiment(spark, sf_dir) if which == "quality" else price_experiment(spark, sf_dir, [model])
    return experiment, explanation.refit(experiment, model)


@query(
    "stratified_fold_sizes",
    """WITH c AS (SELECT l_returnflag AS label, count(*) AS n FROM lineitem GROUP BY 1), f AS (SELECT unnest(range(5))::INT AS fold)
SELECT label, fold, (n - fold + 4) // 5 AS n FROM c, f""",
)
def stratified_fold_sizes(spark, sf_dir):
    plan = modelling.Plan("l_returnflag", "multiclass_classification", ["l_quantity"], [], [], "accuracy", [])
    frame = modelling.model_frame(LINEITEM.read(spark, sf_dir), plan)
    folded = modelling.with_folds(frame, plan, modelling.usable_folds(frame, plan))
    return folded.groupBy("label", "fold").agg(F.count(F.lit(1)).alias("n"))


@query(
    "regression_fold_sizes",
    "WITH f AS (SELECT unnest(range(5))::INT AS fold) SELECT fold, ((SELECT count(*) FROM orders) - fold + 4) // 5 AS n FROM f",
)
def regression_fold_sizes(spark, sf_dir):
    plan = modelling.Plan("o_totalprice", "regression", ["o_custkey"], [], [], "rmse", [])
    frame = modelling.model_frame(ORDERS.read(spark, sf_dir), plan)
    return modelling.with_folds(frame, plan, 5).groupBy("fold").agg(F.count(F.lit(1)).alias("n"))


@query(
    "gap_fills",
    f"""SELECT 'gap' AS "column", CAST(median(gap) AS VARCHAR) AS fill FROM {PLANTED.sql}
UNION ALL SELECT 'l_returnflag', (SELECT l_returnflag FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)""",
)
def gap_fills(spark, sf_dir):
    plan = modelling.Plan("net", "regression", ["gap"], ["l_returnflag"], [], "rmse", [])
    fills = modelling.gap_fills(PLANTED.read(spark, sf_dir), plan, {"gap", "l_returnflag"})
    return spark.createDataFrame([(c, str(v)) for c, v in fills.items()], '`column` string, fill string')


# ---- gap fills and vectors of all folds -------------------------------------------------------

FOLDS = Relation(
    "lineitem", [],
    {
        "row": ("l_orderkey * 8 + l_linenumber", "i"), "fold": ("l_orderkey % 5", "i"), "label": ("l_tax", "d"),
        "gap": ("CASE WHEN l_linenumber = 7 THEN NULL ELSE l_discount END", "d"),
        "size": ("CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity + l_tax END", "d"), "price": ("l_extendedprice", "d"),
        "flag": ("CASE WHEN l_linenumber = 2 THEN NULL ELSE l_returnflag END", "s"),
        "rare": ("CASE WHEN l_orderkey % 5 = 1 AND l_linenumber = 1 THEN 'only here' WHEN l_quantity > 30 THEN 'many' ELSE 'few' END", "s"),
    },
)
FOLD_PLAN = modelling.Plan("label", "regression", ["gap", "size", "price"], ["flag", "rare"], [], "rmse", [])
FOLD_FILLS = f"""f AS (SELECT unnest(range(5))::INT AS held), d AS (SELECT * FROM {FOLDS.sql}),
fills AS (SELECT held, median(gap) AS gap, median("size") AS "size", (SELECT flag FROM d e WHERE e.fold <> held AND flag IS NOT NULL
  GROUP BY flag ORDER BY count(*) DESC, flag LIMIT 1) AS flag FROM f JOIN d ON d.fold <> f.held GROUP BY held)"""


@query(
    "gap_fills_by_fold",
    f"""WITH {FOLD_FILLS} SELECT 'gap' AS "column", held AS fold, gap AS number, NULL::VARCHAR AS label FROM fills
UNION ALL SELECT 'size', held, "size", NULL FROM fills UNION ALL SELECT 'flag', held, NULL, flag FROM fills""",
)
def gap_fills_by_fold(spark, sf_dir):
    return modelling.fold_fills(FOLDS.read(spark, sf_dir), FOLD_PLAN, 5, {"gap", "size", "flag"}).select(
        "column", F.col("fold").cast("int").alias("fold"), "number", "label"
    )


@query(
    "labels_by_fold",
    f"""WITH f AS (SELECT unnest(range(5))::INT AS fold), d AS (SELECT fold AS own, flag, rare FROM {FOLDS.sql})
SELECT DISTINCT 'flag' AS "column", f.fold, flag AS label FROM f JOIN d ON own <> f.fold WHERE flag IS NOT NULL
UNION ALL SELECT DISTINCT 'rare', f.fold, rare FROM f JOIN d ON own <> f.fold""",
)
def labels_by_fold(spark, sf_dir):
    found = modelling.fold_labels(FOLDS.read(spark, sf_dir), FOLD_PLAN, 5)
    return found.select("column", F.col("fold").cast("int").alias("fold"), F.explode("labels").alias("label"))


def _flag_sql(column: str) -> str:
    """Flags of a label in all rows, where the training part knows the label; places by label order."""
    return f"""SELECT held, '{column}' AS part, place, sum((x.v = l.v)::INT)::DOUBLE AS total FROM
(SELECT held, v, row_number() OVER (PARTITION BY held ORDER BY v) - 1 AS place FROM (SELECT DISTINCT held, {column} AS v FROM f JOIN d ON d.fold <> f.held WHERE {column} IS NOT NULL)) l
JOIN (SELECT held, coalesce(d.{column}, {'fills.flag' if column == 'flag' else 'NULL'}) AS v FROM fills, d) x USING (held) GROUP BY ALL"""


@query(
    "fold_vectors",
    f"""WITH {FOLD_FILLS}, flags AS ({_flag_sql('flag')} UNION ALL {_flag_sql('rare')}),
numbers AS (SELECT held, sum(coalesce(d.gap, fills.gap)) AS a, sum(coalesce(d."size", fills."size")) AS b, sum(price) AS c FROM fills, d GROUP BY held)
SELECT held, 'flags' AS part, (place + CASE WHEN part = 'rare' THEN 3 ELSE 0 END)::INT AS place, total FROM flags
UNION ALL SELECT held, 'numbers', unnest([0, 1, 2])::INT, round(unnest([a, b, c]), 2) FROM numbers""",
)
def fold_vectors(spark, sf_dir):
    """Sums of every place of the vectors that models of each fold see."""
    prepared = modelling.prepared_folds(FOLDS.read(spark, sf_dir), FOLD_PLAN, 5, [], {"gap", "size", "flag"})
    sums = None
    for held, vectors in enumerate(prepared):
        for part in ("flags", "numbers"):
            own = vectors.select(F.posexplode(vector_to_array(F.col(part))).alias("place", "v")).groupBy("place").agg(F.sum("v").alias("total"))
            own = own.select(F.lit(held).alias("held"), F.lit(part).alias("part"), "place", F.round("total", 2).alias("total"))
            sums = own if sums is None else sums.union(own)
    return sums


@query("candidate_models", "SELECT * FROM (VALUES ('linear_regression', 1, true), ('decision_tree', 2, false), ('random_forest', 3, false), ('gradient_boosting', 4, false)) t(model, rank, is_baseline) WHERE rank <= CASE WHEN (SELECT count(*) FROM lineitem) >= 500 THEN 4 ELSE 3 END")
def candidate_models(spark, sf_dir):
    plan = modelling.modelling_plan(LINEITEM.read(spark, sf_dir), "l_extendedprice")
    return spark.createDataFrame([(c.name, c.rank, c.baseline) for c in plan.candidates], "model string, rank int, is_baseline boolean")


# ---- scores of given predictions -------------------------------------------------------------

GUESSES = Relation(
    "lineitem", [],
    {
        "fold": ("l_linenumber", "i"), "label": ("l_returnflag", "s"),
        "guess": ("CASE WHEN l_quantity > 20 THEN l_returnflag WHEN l_tax > 0.04 THEN 'A' ELSE 'R' END", "s"),
        "score": ("CASE WHEN l_returnflag = 'R' THEN l_tax ELSE l_discount END", "d"),
    },
)
CLASSES = ["A", "N", "R"]


def guesses(spark, sf_dir):
    place = F.create_map(*[x for i, c in enumerate(CLASSES) for x in (F.lit(c), F.lit(float(i)))])
    return GUESSES.read(spark, sf_dir).select(
        F.col("fold").cast("int").alias("fold"), "label", place[F.col("guess")].alias("prediction"),
        F.array(F.col("score"), F.lit(0.5) - F.col("score"), F.col("score") * F.col("score")).alias("scores"),
    )


@query(
    "class_scores",
    f"""WITH p AS {GUESSES.sql}, k AS (SELECT DISTINCT fold, label AS c FROM p),
s AS (SELECT k.fold, k.c, count(*) FILTER (WHERE label = c AND guess = c) AS tp, count(*) FILTER (WHERE label = c) AS size,
  count(*) FILTER (WHERE guess = c) AS guesses FROM p JOIN k USING (fold) GROUP BY k.fold, k.c),
m AS (SELECT *, CASE WHEN guesses = 0 THEN 0.0 ELSE tp::DOUBLE / guesses END AS pr, tp::DOUBLE / size AS re FROM s)
SELECT fold::INT AS fold, round(sum(tp)::DOUBLE / sum(size), 6) AS accuracy,
  round(sum(size * CASE WHEN pr + re = 0 THEN 0.0 ELSE 2 * pr * re / (pr + re) END) / sum(size), 6) AS f1,
  round(sum(size * pr) / sum(size), 6) AS precision, round(sum(size * re) / sum(size), 6) AS recall FROM m GROUP BY fold""",
)
def class_scores(spark, sf_dir):
    found = modelling.class_scores(guesses(spark, sf_dir), ["fold"], CLASSES)
    return found.select("fold", *[F.round(m, 6).alias(m) for m in ("accuracy", "f1", "precision", "recall")])


def auc_sql(c: str, score: str) -> str:
    return f"""SELECT fold, '{c}' AS c, count(*) FILTER (WHERE label = '{c}') AS p, (sum(r) FILTER (WHERE label = '{c}')
 - count(*) FILTER (WHERE label = '{c}') * (count(*) FILTER (WHERE label = '{c}') + 1) / 2.0)
 / (count(*) FILTER (WHERE label = '{c}')::DOUBLE * count(*) FILTER (WHERE label <> '{c}')) AS auc
 FROM (SELECT *, rank() OVER (PARTITION BY fold ORDER BY {score}) + (count(*) OVER (PARTITION BY fold, {score}) - 1) / 2.0 AS r FROM p) GROUP BY fold"""


@query(
    "ranking_scores",
    f"""WITH p AS {GUESSES.sql}, a AS ({auc_sql('A', 'score')} UNION ALL {auc_sql('N', '(0.5 - score)')} UNION ALL {auc_sql('R', '(score * score)')})
SELECT fold::INT AS fold, round(sum(auc * p) / sum(p), 6) AS roc_auc FROM a GROUP BY fold""",
)
def ranking_scores(spark, sf_dir):
    df = guesses(spark, sf_dir)
    return modelling.ranking_scores(df, CLASSES).withColumn("roc_auc", F.round("roc_auc", 6))


@query(
    "regression_scores",
    """WITH p AS (SELECT l_linenumber AS fold, l_extendedprice AS y, 2000 * l_quantity AS x FROM lineitem)
SELECT fold, round(sqrt(avg(pow(y - x, 2))), 4) AS rmse, round(avg(abs(y - x)), 4) AS mae,
round(1 - sum(pow(y - x, 2)) / (var_pop(y) * count(*)), 6) AS r2 FROM p GROUP BY fold""",
)
def regression_scores(spark, sf_dir):
    df = LINEITEM.read(spark, sf_dir).selectExpr("l_linenumber AS fold", "l_extendedprice AS label", "2000 * l_quantity AS prediction")
    found = modelling.regression_scores(df, ["fold"])
    return found.select("fold", F.round("rmse", 4).alias("rmse"), F.round("mae", 4).alias("mae"), F.round("r2", 6).alias("r2"))


SCORES = Relation(
    "lineitem", [],
    {"model": ("l_returnflag", "s"), "fold": ("l_linenumber", "i"), "value": ("l_quantity", "d")},
)
SUMMARY = f"""WITH s AS (SELECT model, fold, avg(value) AS value FROM {SCORES.sql} GROUP BY 1, 2),
m AS (SELECT model, CASE model WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS rank, model = 'A' AS is_baseline, 'rmse' AS metric,
  avg(value) AS mean, stddev_pop(value) AS std, count(value) AS n_folds FROM s GROUP BY model)"""


def scores_table(spark, sf_dir):
    means = SCORES.read(spark, sf_dir).groupBy("model", "fold").agg(F.avg("value").alias("value"))
    rank = F.when(F.col("model") == "A", 1).when(F.col("model") == "N", 2).otherwise(3)
    return means.select(
        "model", rank.alias("rank"), (F.col("model") == "A").alias("is_baseline"), "fold", F.lit("rmse").alias("metric"), "value",
        F.lit(0.0).alias("seconds"),
    )


@query("score_summary", SUMMARY + " SELECT model, rank, is_baseline, metric, round(mean, 6) AS mean, round(std, 6) AS std, n_folds FROM m")
def score_summary(spark, sf_dir):
    found = modelling.score_summary(scores_table(spark, sf_dir)).drop("seconds")
    return found.withColumn("mean", F.round("mean", 6)).withColumn("std", F.round("std", 6))


@query(
    "best_model",
    SUMMARY + """ SELECT w.model AS best_model, 'rmse' AS metric, round(w.mean, 6) AS score, b.model AS baseline, round(b.mean, 6) AS baseline_mean,
CASE WHEN NOT w.is_baseline THEN round(b.mean - w.mean, 6) END AS gain, NOT w.is_baseline AND w.mean < b.mean AS beat_baseline
FROM (SELECT * FROM m ORDER BY mean, rank LIMIT 1) w, (SELECT * FROM m WHERE is_baseline) b""",
)
def best_model(spark, sf_dir):
    found = modelling.best_model(modelling.score_summary(scores_table(spark, sf_dir)), "rmse")
    return found.withColumns({c: F.round(c, 6) for c in ("score", "baseline_mean", "gain")})


# ---- trained models ---------------------------------------------------------------------------


@query("model_comparison")
def model_comparison(spark, sf_dir):
    """Candidates of the quality target on five shared folds; every metric by mean and spread."""
    return modelling.score_summary(quality_experiment(spark, sf_dir).scores)


@query("cross_validated_regression")
def cross_validated_regression(spark, sf_dir):
    return modelling.score_summary(price_experiment(spark, sf_dir).scores)


@query("held_out_predictions_complete", f"SELECT count(*) AS n, count(DISTINCT rn) AS n_rows, 5 AS n_folds FROM (SELECT row_number() OVER () AS rn FROM {PLANTED.sql})")
def held_out_complete(spark, sf_dir):
    """Every row is predicted exactly once, by a model that did not see it."""
    predictions = price_experiment(spark, sf_dir, ["linear_regression"]).predictions["linear_regression"]
    return predictions.agg(
        F.count("prediction").alias("n"), F.count_distinct("row").alias("n_rows"), F.count_distinct("fold").cast("int").alias("n_folds")
    )


@query(
    "refitted_line",
    """SELECT l_linenumber, count(*) AS n, round(sum(i + s * l_extendedprice) / 1000.0, 3) AS predicted FROM lineitem,
(SELECT regr_slope(net, l_extendedprice) AS s, regr_intercept(net, l_extendedprice) AS i FROM (SELECT l_extendedprice, l_extendedprice * (1 - l_discount) AS net FROM lineitem))
GROUP BY l_linenumber""",
)
def refitted_line(spark, sf_dir):
    """A model refitted on all rows, against the closed form of the same line."""
    plan = modelling.Plan("net", "regression", ["l_extendedprice"], [], [], "rmse", [])
    df = PLANTED.read(spark, sf_dir)
    line = modelling.fit_model("linear_regression", modelling.model_frame(df, plan), plan, [], set())
    found = line.predict(df.select("l_linenumber", "l_extendedprice"))
    return found.groupBy("l_linenumber").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("prediction") / 1000.0, 3).alias("predicted")
    )


@query("permutation_importance")
def permutation_importance(spark, sf_dir):
    experiment, line = fitted(spark, sf_dir, "price", "linear_regression")
    return explanation.permutation_importance(experiment, line)


# a line through two features, so SQL can fit it, repeat the shuffles and split the predictions
SLOPES = Relation(
    "orders", [],
    {
        "row": ("o_orderkey", "i"), "price": ("o_totalprice", "d"), "customer": ("o_custkey", "d"),
        "label": ("2 * o_totalprice + 50 * o_custkey + 1000 * (o_orderkey % 97)", "d"),
    },
)
SLOPES_FIT = f"""WITH d AS (SELECT * FROM {SLOPES.sql}),
m AS (SELECT count(*) AS n, avg(price) AS mp, avg(customer) AS mc, avg(label) AS ml, var_pop(price) AS pp, var_pop(customer) AS cc,
  covar_pop(price, customer) AS pc, covar_pop(price, label) AS pl, covar_pop(customer, label) AS cl FROM d),
line AS (SELECT *, (pl * cc - cl * pc) / (pp * cc - pc * pc) AS bp, (cl * pp - pl * pc) / (pp * cc - pc * pc) AS bc FROM m)"""


def slopes(spark, sf_dir):
    plan = modelling.Plan("label", "regression", ["price", "customer"], [], [], "rmse", [])
    frame = SLOPES.read(spark, sf_dir)
    experiment = modelling.Experiment(plan, frame, [], set(), 5, None)
    return experiment, explanation.refit(experiment, "linear_regression")


@query(
    "line_importance",
    SLOPES_FIT + """, drawn AS (SELECT d.*, repeat, md5('42|' || repeat || '|' || row) AS draw FROM d, (SELECT unnest(range(5)) AS repeat)),
dealt AS (SELECT drawn.*, ('0x' || substr(draw, 1, 8))::BIGINT % greatest(1, ceil(n / 100000.0)::BIGINT) AS bucket FROM drawn, line),
donor AS (SELECT *, coalesce(lead(price) OVER w, first_value(price) OVER w) AS other_price,
  coalesce(lead(customer) OVER w, first_value(customer) OVER w) AS other_customer FROM dealt WINDOW w AS (PARTITION BY repeat, bucket ORDER BY draw, row)),
base AS (SELECT sqrt(avg(pow(label - ml - bp * (price - mp) - bc * (customer - mc), 2))) AS rmse FROM d, line),
moved AS (SELECT repeat, sqrt(avg(pow(label - ml - bp * (other_price - mp) - bc * (customer - mc), 2))) AS price,
  sqrt(avg(pow(label - ml - bp * (price - mp) - bc * (other_customer - mc), 2))) AS customer FROM donor, line GROUP BY repeat),
rise AS (SELECT 'price' AS feature, price - rmse AS x FROM moved, base UNION ALL SELECT 'customer', customer - rmse FROM moved, base),
i AS (SELECT feature, avg(x) AS importance, stddev_pop(x) AS std FROM rise GROUP BY feature)
SELECT feature, round(importance, 3) AS importance, round(std, 3) AS std,
round(greatest(importance, 0) / (SELECT sum(greatest(importance, 0)) FROM i), 6) AS share FROM i""",
)
def line_importance(spark, sf_dir):
    found = explanation.permutation_importance(*slopes(spark, sf_dir))
    return found.select(
        "feature", F.round("importance", 3).alias("importance"), F.round("std", 3).alias("std"), F.round("share", 6).alias("share")
    )


@query(
    "line_contributions",
    SLOPES_FIT + """, c AS (SELECT row, 'price' AS feature, bp * (price - mp) AS x, ml + bp * (price - mp) + bc * (customer - mc) AS prediction, ml FROM d, line
UNION ALL SELECT row, 'customer', bc * (customer - mc), ml + bp * (price - mp) + bc * (customer - mc), ml FROM d, line)
SELECT feature, (row % 7)::INT AS part, count(*) AS n, round(avg(x), 3) AS contribution, round(avg(abs(x)), 3) AS size,
round(avg(prediction), 3) AS prediction, round(avg(ml), 3) AS baseline FROM c GROUP BY 1, 2""",
)
def line_contributions(spark, sf_dir):
    found = explanation.linear_contributions(*slopes(spark, sf_dir))
    return found.groupBy("feature", (F.col("row") % 7).cast("int").alias("part")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("contribution"), 3).alias("contribution"),
        F.round(F.avg(F.abs("contribution")), 3).alias("size"), F.round(F.avg("prediction"), 3).alias("prediction"),
        F.round(F.avg("baseline"), 3).alias("baseline"),
    )


@query(
    "shuffled_column",
    """SELECT repeat, count(*) AS n, sum(l_quantity) AS total, sum(pow(l_quantity, 2)) AS squares, 0 AS unmoved_if_few
FROM lineitem, (SELECT unnest(range(3))::INT AS repeat) GROUP BY repeat""",
)
def shuffled_column(spark, sf_dir):
    """Every value is dealt out exactly once per repeat; fewer than one row in ten gets itself back."""
    frame = LINEITEM.read(spark, sf_dir).select("l_quantity", F.monotonically_increasing_id().alias("row"))
    frame = frame.withColumn("id", F.col("row"))
    donors = explanation.shuffled_donors(frame, ["l_quantity", "id"], frame.count(), 3, 42)
    v = F.col("donor.l_quantity")
    return donors.groupBy("repeat").agg(
        F.count(F.lit(1)).alias("n"), F.sum(v).alias("total"), F.sum(v * v).alias("squares"),
        (F.count_if(F.col("donor.id") == F.col("id")) * 10 > F.count(F.lit(1))).cast("int").alias("unmoved_if_few"),
    )


@query(
    "importance_shares",
    """WITH i AS (SELECT p_type AS feature, avg(p_size) - 25.5 AS importance FROM part GROUP BY p_type)
SELECT feature, round(importance, 6) AS importance,
round(greatest(importance, 0) / coalesce(nullif((SELECT sum(greatest(importance, 0)) FROM i), 0), 1.0), 6) AS share FROM i""",
)
def importance_shares(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    found = explanation.with_shares(part.groupBy(F.col("p_type").alias("feature")).agg((F.avg("p_size") - 25.5).alias("importance")))
    return found.select("feature", F.round("importance", 6).alias("importance"), F.round("share", 6).alias("share"))


@query("top_features", "SELECT p_brand AS feature, round(avg(p_size), 6) AS importance FROM part GROUP BY p_brand ORDER BY avg(p_size) DESC, feature LIMIT 5")
def top_features(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    found = explanation.top_features(part.groupBy(F.col("p_brand").alias("feature")).agg(F.avg("p_size").alias("importance")))
    return found.withColumn("importance", F.round("importance", 6))


@query(
    "confusion_cells",
    f"""WITH p AS {GUESSES.sql}, c AS (SELECT DISTINCT label AS x FROM p)
SELECT a.x AS label, b.x AS predicted, count(p.label) AS n FROM c a CROSS JOIN c b LEFT JOIN p ON p.label = a.x AND p.guess = b.x GROUP BY a.x, b.x""",
)
def confusion_cells(spark, sf_dir):
    return explanation.confusion_cells(guesses(spark, sf_dir), CLASSES)


@query(
    "binary_outcomes",
    """SELECT count(*) FILTER (WHERE quality <> 0 AND toxic <> 0) AS true_negative, count(*) FILTER (WHERE quality <> 0 AND toxic = 0) AS false_positive,
count(*) FILTER (WHERE quality = 0 AND toxic <> 0) AS false_negative, count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS true_positive,
round(count(*) FILTER (WHERE quality = toxic)::DOUBLE / count(*), 6) AS accuracy, count(*) AS n FROM labels""",
)
def binary_outcomes(spark, sf_dir):
    given = LABELS.read(spark, sf_dir).select(F.col("quality").cast("string").alias("label"), F.col("toxic").cast("double").alias("prediction"))
    cells = explanation.confusion_cells(given, ["0", "1"])
    return explanation.binary_outcomes(cells, "0").withColumn("accuracy", F.round("accuracy", 6))


@query("held_out_confusion")
def held_out_confusion(spark, sf_dir):
    experiment = quality_experiment(spark, sf_dir)
    return explanation.confusion_cells(experiment.predictions["decision_tree"], experiment.classes)


@query(
    "positive_classes",
    """(SELECT 'quality' AS source, quality::VARCHAR AS positive_class FROM labels GROUP BY quality ORDER BY count(*), 2 LIMIT 1)
UNION ALL (SELECT 'event_type', event_type FROM events GROUP BY event_type ORDER BY count(*) DESC, 2 LIMIT 1)""",
)
def positive_classes(spark, sf_dir):
    from tablewright.operators.frequency import union_all

    parts = []
    for rel, c in ((LABELS, "quality"), (EVENTS, "event_type")):
        counts = explanation.label_counts(rel.read(spark, sf_dir).select(F.col(c).cast("string").alias("label")))
        parts.append(explanation.positive_class(counts).select(F.lit(c).alias("source"), "positive_class"))
    return union_all(parts)


@query("shapley_contributions")
def shapley_contributions(spark, sf_dir):
    experiment, model = fitted(spark, sf_dir, "quality", "random_forest")
    return explanation.described(explanation.shapley_contributions(experiment, model))


@query("shapley_adds_up", "SELECT count(*)::INT AS n_rows, 0.0::DOUBLE AS worst_gap FROM lineitem")
def shapley_adds_up(spark, sf_dir):
    """Contributions of a row add up to its prediction less its baseline."""
    experiment, line = fitted(spark, sf_dir, "price", "linear_regression")
    found = explanation.shapley_contributions(experiment, line)
    per_row = found.groupBy("row").agg((F.sum("contribution") - F.first("prediction") + F.first("baseline")).alias("gap"))
    return per_row.agg(F.count(F.lit(1)).cast("int").alias("n_rows"), F.abs(F.round(F.max(F.abs("gap")), 6)).alias("worst_gap"))


@query("occlusion_contributions")
def occlusion(spark, sf_dir):
    experiment, line = fitted(spark, sf_dir, "price", "linear_regression")
    return explanation.occlusion_contributions(experiment, line)


@query(
    "described_contributions",
    """WITH c AS (SELECT o_custkey AS row, o_orderpriority AS feature, sum(CASE WHEN o_orderstatus = 'F' THEN 1 WHEN o_orderstatus = 'O' THEN -1 ELSE 0 END)::DOUBLE AS contribution
  FROM orders GROUP BY 1, 2)
SELECT row, feature, contribution, CASE WHEN contribution > 0.0001 THEN 'increases' WHEN contribution < -0.0001 THEN 'decreases' ELSE 'no effect' END AS direction,
row_number() OVER (PARTITION BY row ORDER BY abs(contribution) DESC, feature) AS place FROM c""",
)
def described(spark, sf_dir):
    sign = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", -1).otherwise(0)
    given = ORDERS.read(spark, sf_dir).groupBy(F.col("o_custkey").alias("row"), F.col("o_orderpriority").alias("feature")).agg(
        F.sum(sign).cast("double").alias("contribution")
    )
    return explanation.described(given)


@query(
    "typical_values",
    f"""SELECT 'l_extendedprice' AS "column", CAST(round(median(l_extendedprice), 4) AS VARCHAR) AS value FROM lineitem
UNION ALL SELECT 'gap', CAST(round(median(gap), 4) AS VARCHAR) FROM {PLANTED.sql}
UNION ALL SELECT 'thirds', (SELECT thirds FROM {PLANTED.sql} GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)""",
)
def typical_values(spark, sf_dir):
    found = explanation.typical_values(PLANTED.read(spark, sf_dir), ["l_extendedprice", "gap"], ["thirds"])
    return spark.createDataFrame(
        [(c, v if isinstance(v, str) else str(round(v, 4))) for c, v in found.items()], "`column` string, value string"
    )


@query(
    "dataset_scorecard",
    f"""WITH {issues_cte(MESSY)}, s AS ({SCORE_SQL})
SELECT (SELECT count(*) FROM lineitem) AS n_rows, 14 AS n_columns, CASE WHEN score >= 85 THEN 'Trustworthy' WHEN score >= 70 THEN 'Mostly trustworthy'
WHEN score >= 50 THEN 'Use with caution' ELSE 'Fragile' END AS trust, {GRADE_SQL} AS grade, score, n_issues FROM s""",
)
def scorecard(spark, sf_dir):
    card = dataset_scorecard(MESSY.read(spark, sf_dir), "l_linestatus")
    return card.select("n_rows", "n_columns", "trust", "grade", "score", "n_issues")


@query("scorecard_with_model")
def scorecard_with_model(spark, sf_dir):
    frame = quality_frame(spark, sf_dir)
    profile = Profile.of(frame)
    return dataset_scorecard(frame, "quality", profile, modelling.run_experiment(frame, "quality", profile=profile).complete())
