"""spreadrank: spreading-process analytics on graphs, written for PySpark."""
