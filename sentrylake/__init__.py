"""Insider-threat analytics on Spark DataFrames, with training-data operators in the optional subpackage ``llm``."""
