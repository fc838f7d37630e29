"""Whole plans: validation, catalog, parity, tape reconstruction, stream merging, resolution."""
