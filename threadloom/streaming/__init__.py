"""Streams into the operators' storage."""
