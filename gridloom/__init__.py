"""PySpark-native palette-grid analytics."""
