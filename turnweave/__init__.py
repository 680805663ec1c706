"""Spark-native dialogue analytics: interval algebra, turn assembly, text repair and window planning as DataFrame operators."""
