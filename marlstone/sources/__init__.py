"""Scans and sinks: registered Parquet views, raw capture frames, staged writes, an SQL surface."""
