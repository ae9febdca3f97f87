"""The exploratory report and the feature-selection report as sets of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from gridloom.functions.numeric import numeric_columns, present
from gridloom.operators import association, charts, learning, profiles, selection, statistics
from gridloom.schemas import READING_COLUMNS, SUBMETER_COLUMNS, TARGET


def exploration_report(df: DataFrame, ts_col: str, value: str = TARGET) -> dict[str, DataFrame]:
    """Every table of the exploratory analysis, by name."""
    energy = present(df, READING_COLUMNS) or numeric_columns(df)
    hours = profiles.hourly_profile(df, ts_col, value)
    week = profiles.weekly_profile(df, ts_col, value)
    report = {
        "statistical_summary": statistics.statistical_summary(df, energy),
        "histogram": charts.histogram(df, value),
        "normality": statistics.normality(df, energy),
        "hourly_pattern": profiles.profile_band(hours),
        "peak_hours": profiles.peak_and_low_hour(hours),
        "weekly_pattern": week,
        "weekday_vs_weekend": profiles.weekday_vs_weekend(week),
        "weekday_test": statistics.weekday_weekend_test(df, ts_col, value),
        "correlation_matrix": statistics.pearson_matrix(df, energy),
        "high_correlations": statistics.strong_pairs(df, energy, 0.7),
    }
    if all(c in df.columns for c in SUBMETER_COLUMNS):
        report["submeter_consumption"] = profiles.submeter_shares(df, value)
    return report


def selection_report(df: DataFrame, features: list[str], target: str, trees: int = 100) -> dict[str, DataFrame]:
    """Every table of the feature-selection analysis, by name."""
    known = df.select(*features, target).dropna()
    correlations = association.target_association(known, features, target)
    information = association.mutual_information(known, features, target)
    forest = learning.fit(known, features, learning.selection_forest(target, trees))
    weights = learning.importances(known, {"Random Forest": forest}, features)
    pairs = statistics.strong_pairs(known, features)
    variance = statistics.explained_variance(known, features)
    return {
        "target_correlations": correlations,
        "mutual_information": information,
        "rf_importance": weights,
        "f_statistics": statistics.f_test(known, features, target),
        "multicollinearity": pairs,
        "pair_advice": selection.pair_advice(pairs, weights),
        "pca": variance,
        "pca_components": statistics.components_for(variance),
        "recommended": selection.consensus_features(correlations, information, weights),
    }
