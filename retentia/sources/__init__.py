"""Readers, writers and the activity-log adapter over the driver tables."""
