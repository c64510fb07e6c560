"""Readers and writers: disclosure archives, the Parquet foundation, lenses over other tables."""
