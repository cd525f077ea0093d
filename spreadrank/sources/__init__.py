"""Readers and writers of graphs, states, scores and run records."""
