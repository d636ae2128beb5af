"""PySpark-native windowed stream analytics."""
