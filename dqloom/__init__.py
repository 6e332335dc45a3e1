"""dqloom: data-validation for ETL pipelines, expressed as Spark DataFrame jobs.

Layers:

* ``functions``  column expressions (check predicates, JSON/VARIANT access, endpoint routing)
* ``operators``  table-to-table operators (checks, fusion, flatten, marts, mutations, diff, ledger, reports)
* ``sources``    readers and writers (raw envelopes, entity tables, reports, exports, generated data)
* ``plans``      declared suites, schemas, strategies and experiment plans
* ``streaming``  incremental ingestion and validation of newly arrived batches
"""

__version__ = "0.1.0"
