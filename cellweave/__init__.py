"""cellweave: spatio-temporal knowledge-graph analytics as PySpark DataFrame jobs."""
