"""trimodel: a PySpark-native engine for relational, document and key-value tables."""
