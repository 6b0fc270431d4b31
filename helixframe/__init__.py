"""A PySpark-native engine for single-cell read quantification."""
