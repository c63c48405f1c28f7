"""sightline: a PySpark-native engine for exploring, ranking and labelling large corpora."""
