"""Operators over pixel tables: counting, merging, coarsening, balancing, expected curves and matrix blocks."""
