"""Readers and sinks: directory walks, metadata files, versioned tables."""
