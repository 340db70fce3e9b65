"""netlens: a PySpark-native engine for IP-network databases."""

__version__ = "0.1.0"
