"""Readers and writers with explicit schemas and checks."""
