"""Orrery: a PySpark-native analytics engine."""
