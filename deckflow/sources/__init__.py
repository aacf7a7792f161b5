"""Sources: parquet bindings, signal ingestion, documents and model responses."""
