"""Streaming entries."""
