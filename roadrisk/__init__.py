"""roadrisk: driving-risk analytics as Spark DataFrame operators.

Sub-packages: ``functions`` (scalar expressions and skew-safe building
blocks), ``sources`` (JSON/Parquet/CSV readers and sinks), ``operators``
(events, trips, drivers, features, analytics, evaluation, scoring, models),
``plans`` (views over the test tables and the registered queries) and
``streaming`` (Structured Streaming forms).
"""

__version__ = "0.1.0"
