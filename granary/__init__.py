"""A PySpark-native analytics library: sources, plans, and the training-data operators in ``llm``."""
