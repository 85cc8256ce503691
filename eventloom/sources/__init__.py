"""Readers and writers of signal, event, model and alignment files."""
