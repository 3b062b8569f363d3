"""Scans of records and files of sketch state, and sinks."""
