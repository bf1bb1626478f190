"""dealmill: a PySpark-native analytics engine for deal-intelligence data."""
