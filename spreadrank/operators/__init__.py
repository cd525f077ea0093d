"""Graph, state, traversal, centrality, sampling and evaluation operators; all take and give DataFrames."""
