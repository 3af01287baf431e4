"""skein: a PySpark-native engine for source-code intelligence relations."""
