"""A PySpark-native engine for bibliographic catalogue data."""
