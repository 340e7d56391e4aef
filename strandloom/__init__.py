"""A PySpark-native engine for variant files, triples and training-data pipelines."""
