"""Operators from DataFrame to DataFrame: load strategies, statistics, pruning, schema resolution."""
