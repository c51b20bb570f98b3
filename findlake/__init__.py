"""findlake: a PySpark-native engine for security-finding analytics and corpus preparation."""
