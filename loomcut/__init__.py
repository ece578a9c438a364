"""loomcut: a PySpark-native engine for curating, batching and scoring media metadata."""
