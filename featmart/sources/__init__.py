"""Scans, slices, sinks and materialised tables."""
