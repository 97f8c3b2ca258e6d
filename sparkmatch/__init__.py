"""Subgraph matching on Spark: find or count the embeddings of a small labelled query graph in a large one."""
