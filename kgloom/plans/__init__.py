"""Query front ends that compile to DataFrames."""
