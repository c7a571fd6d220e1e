"""weftline: a PySpark-native analytics engine written as plain DataFrame, SQL and streaming code."""
