"""Scans, sinks and table inventories."""
