"""Scans of filing indexes, reports and reference files, and an adapter over the driver's tables."""
