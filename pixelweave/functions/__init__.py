"""Scalar rules: genomes, regions, column expressions and numpy kernels."""
