"""Readers: Parquet tables, fixed-width text, and the shared scratch folder."""
