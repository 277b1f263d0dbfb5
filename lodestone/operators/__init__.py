"""Operators: retrieval, links, merges, queues, chunks and reports."""
