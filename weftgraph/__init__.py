"""Graph analytics and balanced graph partitioning over plain DataFrames.

A graph is an edge table (src, dst) and, where vertices carry something, a vertex table (id, ...).
Iterative programs run from a small driver loop; every superstep is a few joins and aggregations.
"""
