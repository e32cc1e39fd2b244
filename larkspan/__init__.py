"""A PySpark-native analytics engine for radio-mesh records, node maps, loss tables and rasters."""
