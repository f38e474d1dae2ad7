"""Exporter CSV, replay, message log files and the stored tables."""
