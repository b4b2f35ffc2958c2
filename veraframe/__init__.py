"""PySpark-native toolkit for governing and evaluating labelled media datasets."""
