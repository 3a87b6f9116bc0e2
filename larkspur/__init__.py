"""PySpark-native analytics over multi-turn conversation datasets."""
