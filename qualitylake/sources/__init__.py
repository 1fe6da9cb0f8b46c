"""Readers that turn report and source text into fact tables."""
