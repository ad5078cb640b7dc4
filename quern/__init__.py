"""quern: a PySpark-native engine for transaction quality, entity resolution and corpus work."""

__version__ = "0.1.0"
