"""Readers and writers for message tables, experiment results and reports."""
