"""Sinks: distributed writers for vectors, CSV tables and saved models."""
