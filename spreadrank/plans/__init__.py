"""Registered queries, the graphs that they run on, and their SQL."""
