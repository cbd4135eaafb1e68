"""Scans, sinks, artifacts and the driver's fixture views."""
