"""DataFrame operators of ingest, log, tables and queries."""
