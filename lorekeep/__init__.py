"""A Spark-native engine for collections of linked notes: query languages, ranked retrieval, graph and reports."""
