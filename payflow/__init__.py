"""payflow: payment analytics as Spark jobs.

Sub-packages:
  functions  Column expressions (money, calendar, hashing, risk scoring)
  operators  reusable DataFrame operators (windows, global ranks, joins, folds, SCD2, checks)
  sources    readers and writers (CSV/JSON/CDC/XML/binary sources, idempotent sinks)
  plans      the jobs: bindings of the test tables, marts, reports, features, ML, privacy
  streaming  Structured Streaming jobs built on the same operators
"""

__version__ = "0.1.0"
