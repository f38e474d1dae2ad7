"""The public queries and the batch ingest, composed from operators."""
