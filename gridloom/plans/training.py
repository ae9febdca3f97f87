"""Features to scored models."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from gridloom.operators import evaluation, learning
from gridloom.operators.trees import FOREST, fit_boosted, fit_forest
from gridloom.session import settle


@dataclass
class TrainingRun:
    train: DataFrame
    test: DataFrame
    predictions: DataFrame
    scores: DataFrame
    importances: DataFrame
    report: DataFrame


def train_and_evaluate(
    table: DataFrame,
    features: list[str],
    target: str,
    order: list[str],
    max_samples: int | None = None,
    trees: int = 100,
    rounds: int = 300,
    test_share: float = 0.2,
    own_trees: bool = False,
) -> TrainingRun:
    """Split by time, optionally thin the training side, fit three models, score the rest.

    Trees are grown level by level on statistics that executors aggregate, so the
    training rows stay distributed. Thinning is off by default. ``own_trees`` grows them by the original's
    rules (penalties, patience, least rows of a split) instead of Spark ML's, in more and smaller jobs;
    rows that ``order`` does not tell apart are drawn together then.
    """
    table = settle(table.select(*dict.fromkeys([*order, *features, target])).dropna())
    train, test = learning.chronological_split(table, order, test_share)
    if max_samples:
        train = learning.stratified_sample(train, target, max_samples, order)
    train = settle(learning.flag_validation(train, order))
    models = {"Linear Regression": learning.fit(train, features, learning.linear_model(target))}
    if own_trees:
        rules = replace(FOREST, features_per_node=max(1, math.isqrt(len(features))))
        models["Random Forest"] = fit_forest(train, features, target, order, trees, rules=rules)
        models["Gradient Boosting"] = fit_boosted(train, features, target, order, rounds=rounds)
    else:
        models["Random Forest"] = learning.fit(train, features, learning.forest_model(target, trees))
        models["Gradient Boosting"] = learning.fit(train, features, learning.boosted_model(target, rounds))
    predictions = learning.score(models, test, target, order)
    scores = evaluation.evaluate(predictions)
    return TrainingRun(
        train,
        test,
        predictions,
        scores,
        learning.importances(table, models, features),
        evaluation.run_report(scores, train, test, len(features)),
    )
