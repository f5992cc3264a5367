"""Analytics over notice records, expressed as Spark DataFrame plans.

Sub-packages: ``functions`` (column expressions), ``operators`` (DataFrame
to DataFrame), ``sources`` (readers and writers), ``plans`` (named queries with
their SQL counterparts), ``streaming`` (the same operators over unbounded
input).  The optional ``llm`` sub-package builds on these and nothing here
depends on it.
"""
