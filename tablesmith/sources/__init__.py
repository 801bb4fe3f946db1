"""Readers, providers and sinks."""
