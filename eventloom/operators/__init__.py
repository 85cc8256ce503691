"""Operators on signals, event sequences and alignments."""
