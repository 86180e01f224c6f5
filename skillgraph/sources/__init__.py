"""Readers, ingestion rules and writers."""
