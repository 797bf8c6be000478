"""STR-1..3: the same ingest as a stream of landed log files or failures."""
