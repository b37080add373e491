"""Graph operators over plain edge and vertex DataFrames."""
