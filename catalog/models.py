"""Training, ensemble and explanation queries. Trained models have no SQL form, so these are checked by tests."""

from __future__ import annotations

from catalog.base import query
from ebbtide.operators import evaluation, explain, scoring, split, training
from ebbtide.operators.impute import Imputer
from ebbtide.operators.transformers import FeatureEngineer
from ebbtide.plans import jobs
from ebbtide.schema import ID
from ebbtide.session import work_path
from ebbtide.sources.snapshot import snapshot


def complete_customers(spark, folder):
    """All customers; those without any order get the training customers' median price, as models take no missing values.

    The snapshot is computed once and written; the passes of the split, the fills and what follows read that table.
    """
    found, path = snapshot(spark, folder), work_path(spark, "customers")
    found.write.parquet(path)
    rows = split.stratified_split(spark.read.schema(found.schema).parquet(path), ID, "Churn")
    fills = Imputer(create_indicators=False).fit(split.train_test(rows)[0])
    return fills.transform(rows.drop("split"))


def prepared(spark, folder):
    train, test, features = jobs.build_features(complete_customers(spark, folder), work_path(spark, "features"))
    return training.as_training(train), training.as_training(test), features


def _predictions(model, test):
    return model.transform(test).select(ID, "label", "probability", "prediction")


@query("train_logistic")
def train_logistic(spark, folder):
    train, test, _ = prepared(spark, folder)
    return _predictions(training.train(train, "logistic-baseline"), test)


@query("train_forest")
def train_forest(spark, folder):
    train, test, _ = prepared(spark, folder)
    return _predictions(training.train(train, "rf-default"), test)


@query("train_boosted")
def train_boosted(spark, folder):
    train, test, _ = prepared(spark, folder)
    return _predictions(training.train(train, "xgb-default"), test)


@query("train_boosted_by_leaves")
def train_boosted_by_leaves(spark, folder):
    train, test, _ = prepared(spark, folder)
    return _predictions(training.train(train, "lgbm-default"), test)


@query("train_voting")
def train_voting(spark, folder):
    train, test, _ = prepared(spark, folder)
    return _predictions(training.train_voting(train), test)


@query("train_voting_by_majority")
def train_voting_by_majority(spark, folder):
    train, test, _ = prepared(spark, folder)
    return training.train_voting(train, voting="hard").transform(test).select(ID, "label", "prediction")


@query("train_stacking")
def train_stacking(spark, folder):
    train, test, _ = prepared(spark, folder)
    return _predictions(training.train_stacking(train, ID), test)


@query("model_comparison")
def model_comparison(spark, folder):
    train, test, _ = jobs.build_features(complete_customers(spark, folder))
    return jobs.compare_models(train, test, list(training.PROFILES))[0]


@query("model_reloaded")
def model_reloaded(spark, folder):
    train, test, _ = prepared(spark, folder)
    path = work_path(spark, "model")
    training.save(training.train(train, "logistic-baseline"), path)
    return _predictions(training.load(path), test)


@query("coefficient_importance")
def coefficient_importance(spark, folder):
    train, _, _ = prepared(spark, folder)
    return training.feature_importance(spark, training.train(train, "logistic-baseline"))


@query("impurity_importance")
def impurity_importance(spark, folder):
    train, _, _ = prepared(spark, folder)
    return training.feature_importance(spark, training.train(train, "rf-default"))


@query("model_responses")
def model_responses(spark, folder):
    """Raw rows through the fitted features and a trained model to response rows."""
    rows = complete_customers(spark, folder)
    train, test = split.train_test(split.stratified_split(rows, ID, "Churn"))
    features = FeatureEngineer().fit(train)
    model = training.train(training.as_training(features.transform(train)), "logistic-baseline")
    return scoring.responses(scoring.score(test.drop("Churn"), features, model), 1).drop("prediction_date")


@query("model_gate")
def model_gate(spark, folder):
    train, test, _ = jobs.build_features(complete_customers(spark, folder))
    return jobs.gate(test, training.train(training.as_training(train), "logistic-baseline"))


@query("linear_contributions")
def linear_contributions(spark, folder):
    train, test, _ = prepared(spark, folder)
    model = training.train(train, "logistic-baseline")
    return explain.long_contributions(explain.explain(test, model, ID), ID)


@query("forest_contributions")
def forest_contributions(spark, folder):
    train, test, _ = prepared(spark, folder)
    return explain.long_contributions(explain.explain(test, training.train(train, "rf-default"), ID), ID)


@query("boosted_contributions")
def boosted_contributions(spark, folder):
    train, test, _ = prepared(spark, folder)
    return explain.long_contributions(explain.explain(test, training.train(train, "xgb-conservative"), ID), ID)


@query("contribution_importance")
def contribution_importance(spark, folder):
    train, test, _ = prepared(spark, folder)
    return explain.global_importance(explain.explain(test, training.train(train, "rf-default"), ID))


@query("contributions_of_extremes")
def contributions_of_extremes(spark, folder):
    """The test customers with the highest and the lowest score, explained."""
    train, test, _ = prepared(spark, folder)
    model = training.train(train, "logistic-baseline")
    explained = explain.explain(test, model, ID)
    ends = evaluation.score_extremes(model.transform(test), ID).first()
    return explain.explain_one(explained, ID, ends["highest"]).unionByName(explain.explain_one(explained, ID, ends["lowest"]))


@query("contribution_dependence")
def contribution_dependence(spark, folder):
    train, test, _ = prepared(spark, folder)
    model = training.train(train, "logistic-baseline")
    return explain.dependence(explain.explain(test, model, ID), "Tenure")
