"""Readers and writers that Spark has no format for, all through Spark's own file access unless said otherwise."""
