"""Readers, key extraction and sinks."""
