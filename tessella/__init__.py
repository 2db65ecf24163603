"""tessella: corpus, retrieval, places and evaluation analytics on PySpark."""
