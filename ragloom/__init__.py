"""ragloom: retrieval-augmented QA data work as Spark DataFrame operators.

Subpackages: ``functions`` (Column expressions), ``operators`` (DataFrame ->
DataFrame steps), ``sources`` / ``sinks`` (scans and writes), ``plans``
(composite jobs and the check catalog), ``streaming`` (incremental ingest).
"""

__version__ = "0.1.0"
