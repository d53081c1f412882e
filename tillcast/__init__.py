"""tillcast: retail demand and inventory analytics as Spark DataFrame plans.

Subpackages: ``sources`` (readers, file gate, driver-table adapter),
``operators`` (table-in/table-out operators), ``functions`` (column helpers),
``plans`` (registered queries, SQL oracle, batch ingest job), ``streaming``
(file-source ingestion).
"""

__version__ = "0.1.0"
