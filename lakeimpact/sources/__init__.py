"""Readers, table sinks and record formats."""
