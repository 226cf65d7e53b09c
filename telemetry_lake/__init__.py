"""telemetry_lake: governed telemetry analytics as Spark DataFrame jobs.

Every public operator is a function from DataFrames to a DataFrame, so the
same code serves batch jobs, Structured Streaming micro-batches and SQL
views.  Subpackages:

* ``sources``    landing-zone NDJSON, published tables, scratch locations
* ``operators``  expectations, medallion layers, analytics, dashboards,
                 governance, prompt routing, knowledge index
* ``functions``  reusable column expressions and SQL table functions
* ``plans``      the registered query catalogue and its DuckDB oracle SQL
* ``streaming``  availableNow ingestion and gold refresh jobs
"""

__version__ = "0.1.0"
