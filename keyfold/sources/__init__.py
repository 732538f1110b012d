"""Readers and writers of the raw binary formats, and tables as mutation logs."""
