"""linkloom: knowledge retrieval and link-graph analytics as Spark DataFrame plans."""
