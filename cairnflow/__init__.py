"""Cairnflow: a retrieval-analytics and text-processing engine on PySpark DataFrames."""
