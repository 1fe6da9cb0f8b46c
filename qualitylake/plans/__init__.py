"""Whole jobs put together from operators, and projections of the driver tables."""
