"""A PySpark-native analytics engine for spatial single-cell data."""
