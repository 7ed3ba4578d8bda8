"""millrace: a PySpark-native engine for preparing, splitting, scoring and analysing model-training records."""
