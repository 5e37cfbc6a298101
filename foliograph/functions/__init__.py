"""Scalar functions: distances, sizes, durations, sort keys."""
