"""Readers and writers of annotation, sequence, variant and junction-count data."""
