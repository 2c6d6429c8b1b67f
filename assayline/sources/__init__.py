"""Scans and sinks: driver-table adapter, CSV/JSON files, model and trial stores."""
