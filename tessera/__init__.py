"""tessera: a memory-graph analytics engine and training-data toolkit on PySpark."""
