"""Pairs that keep arriving: counts are additive, so each batch is counted and added."""
