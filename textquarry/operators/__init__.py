"""DataFrame operators: change detection, ingest, search, collection maintenance, hits."""
