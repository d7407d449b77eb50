"""Sources and sinks: parquet / CSV tables, key tables, audit tables."""
