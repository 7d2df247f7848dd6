"""Versioned, content-addressed key-value analytics as DataFrame plans."""
