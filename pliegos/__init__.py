"""Gazette-style document processing and training-data operators on PySpark DataFrames."""
