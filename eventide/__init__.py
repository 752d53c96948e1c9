"""Event-stream analytics on Spark: ingest, journal, perceive, roll up, verify.

Every public function takes and returns DataFrames (or Columns) and is lazy
unless its name says it writes.  Sessions must run with a UTC time zone, see
:func:`eventide.session.build`.
"""

from eventide.params import IngestParams, PerceptionParams, TrendParams

__all__ = ["IngestParams", "PerceptionParams", "TrendParams"]
