"""Readers and writers: record tables, workbooks, the versioned index."""
