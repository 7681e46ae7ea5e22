"""Time-series tables made fit for forecasting: profile, diagnosis, cleaning and validation on Spark."""
