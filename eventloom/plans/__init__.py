"""Whole jobs: correction, parameter search."""
