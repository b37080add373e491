"""Driver-side loops and lineage control."""
