"""Spark-native training, scoring and evaluation of classical models, with operators for training text."""
