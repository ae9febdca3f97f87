"""Spark-native analytics over household electricity readings.

Every operator is a plain function from DataFrame to DataFrame, so pipelines are
chains of ``df.transform(...)``.
"""

from gridloom.session import build_session, scratch_folder, settle

__all__ = ["build_session", "scratch_folder", "settle"]
