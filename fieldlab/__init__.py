"""Spark-first analytics for environmental monitoring results.

Modules: ``functions`` (column expressions), ``operators`` (DataFrame ->
DataFrame operators), ``sources`` (readers, sinks, refresh), ``streaming``
(file-stream ingest), ``plans`` (the display action, the registered query
catalog and its SQL twins).
"""

__version__ = "0.1.0"
