"""Spark-native analytics over keyed price series."""
