"""Operators: reads, full text, vectors, graphs, fusion, lifecycle and maintenance."""
