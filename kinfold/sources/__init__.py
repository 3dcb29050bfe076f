"""Readers: Parquet tables and folders of images."""
