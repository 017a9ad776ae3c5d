"""A PySpark-native engine for faceted exploration of page-view data."""
