"""quarrygraph: hybrid knowledge graphs and multi-hop retrieval as Spark DataFrame plans."""
