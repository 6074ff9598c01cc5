"""lumispark: Spark-native analytics for microscopy measurements and image stacks."""
