"""Model operators on tables: features, clustering, anomalies, classification, evaluation."""
