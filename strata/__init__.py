"""strata: research-dataset operators on Spark DataFrames.

Every public function takes and returns DataFrames (or Columns); nothing
collects rows to the driver. Sub-packages:

* ``sources``   – readers for records, URL lists, archives and API documents
* ``sinks``     – JSONL / CSV / Parquet / table writers and ``publish``
* ``functions`` – Column expressions (URLs, text, hashes, charsets, amounts)
* ``operators`` – projections, extraction, filters, joins, aggregates, windows
* ``plans``     – end-to-end flows composed from the operators
* ``streaming`` – Structured Streaming versions of ingest and monitoring
"""

__version__ = "0.1.0"
