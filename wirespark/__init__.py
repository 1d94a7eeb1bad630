"""A PySpark-native engine for compact binary XML and the operators of training-data pipelines."""
