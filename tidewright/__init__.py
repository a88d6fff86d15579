"""tidewright: data quality, features and analytics for regular time series, as Spark DataFrame transforms."""
