"""Jobs composed from the operators: ingest, train, report."""
