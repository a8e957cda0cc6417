"""Pattern queries compiled to DataFrames."""
