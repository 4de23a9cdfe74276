"""Spark-native frame-sequence quality analytics and training-data operators."""
