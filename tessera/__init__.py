"""Tessera: a PySpark-native engine for workflow state, code analysis and corpus preparation."""
