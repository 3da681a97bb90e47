"""Recommender feature engineering, blending and evaluation on Spark DataFrames.

Every operator is a plain function ``f(df, ...) -> DataFrame`` and every scalar
function a plain ``f(column, ...) -> Column``; Catalyst plans the work.
"""
