"""Operators of a training-data pipeline, each a Spark job over whole tables.

Nothing else in the library imports this subpackage. ``queries`` registers one
query per operator; ``corpus_pipeline.py`` at the repository top chains four of
them into a filtering and encoding run.
"""
