"""Readers and writers: driver tables, CSV/JSON/Parquet sinks, stores."""
