"""Readers and writers: raw source adapters and export sinks."""
