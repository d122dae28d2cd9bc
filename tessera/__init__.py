"""Tessera: a PySpark-native analytics engine of lazy DataFrame operators."""
