"""tallyweir: a PySpark-native engine for provenance-tracked tables and text funnels."""
