"""meshquill: Spark-native analytics over block-structured simulation output."""
