"""Spark-native analytics over wearable-sensor series: intervals, daily rollups, baselines and assessments."""
