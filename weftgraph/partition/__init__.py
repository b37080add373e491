"""Balanced k-way partitioning by label propagation."""
