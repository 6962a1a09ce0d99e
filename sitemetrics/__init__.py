"""Multi-site operations analytics on PySpark: occupancy, revenue, churn, anomalies."""
