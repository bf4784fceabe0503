"""Spark-first analytics over ordered frame sequences.

Every public operator is a function from DataFrames to DataFrames; Catalyst
plans them.  Sub-packages: ``sources`` (views, readers and writers),
``functions`` (column expressions), ``operators`` (relational operators and
grouped kernels), ``plans`` (named queries and their SQL oracles) and
``streaming`` (Structured Streaming forms).
"""
