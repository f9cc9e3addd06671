"""A PySpark-native engine for text, graph and event-log analytics."""
