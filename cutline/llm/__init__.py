"""Operators for training-text pipelines, built on DataFrames of documents."""
