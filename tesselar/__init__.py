"""tesselar: a PySpark-native engine for turning document collections into a
queryable knowledge graph (DataFrame operators only; nothing runs on import)."""

__version__ = "0.1.0"
