"""facetwise — inventory pricing analytics for graded, individually priced goods,
expressed as Spark DataFrame jobs.

Public surface: plain functions ``DataFrame -> DataFrame`` grouped by concern:

* ``facetwise.sources``   — feed views, ingest (CSV, header detection, alias
  resolution, snapshots), status tables
* ``facetwise.functions`` — Column expressions (canonicalisation, size binning,
  bands, rounding) and distributed helpers (exact nearest-rank quantile,
  keep-last dedupe)
* ``facetwise.operators`` — matching, selling intelligence, sales cohorts,
  decision matrix, carat matrix, reports, change tracking
* ``facetwise.plans``     — the named queries over the driver tables
* ``facetwise.streaming`` — Structured Streaming forms of the incremental ops
"""

__version__ = "0.1.0"
