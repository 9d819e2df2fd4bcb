"""Sinks: Parquet result (K1), keyed archive upsert (K2), ratings CSV (K3)."""
