"""Scans and sinks: parquet views, typed / text CSV, parquet / CSV / JSON writers."""
