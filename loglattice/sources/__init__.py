"""Readers and writers: log lines, the raw vault, result tables, search documents."""
