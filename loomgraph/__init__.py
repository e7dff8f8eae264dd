"""loomgraph: knowledge-hypergraph analytics as PySpark DataFrame jobs."""
