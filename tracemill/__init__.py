"""Data work for distilling a model from recorded agent trajectories, on Spark DataFrames."""
