"""qaspark: evaluate question-answering / retrieval runs as Spark jobs.

Layout
------
functions/   Column -> Column building blocks (text metrics, groundedness,
             response parsing, vectors, column helpers) and SQL registration.
operators/   DataFrame -> DataFrame operators (scoring, reports, bootstrap,
             retrieval, positions, grid, audit, inference stand-ins).
sources/     Readers for corpora, gold sets and messy run-log files.
sinks/       Writers for reports, audit tables and per-group files.
plans/       End-to-end plans: the run-log view over the driver tables,
             the analysis plan, the benchmark plan, the ingest plan, and
             the query catalog used by ``__spark_entry__``.
streaming/   The ingest plan as a Structured Streaming file source.
"""

__version__ = "0.1.0"
