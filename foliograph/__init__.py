"""Foliograph: document-object-graph analytics on PySpark DataFrames."""
