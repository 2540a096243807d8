"""tidecast: hierarchical daily demand forecasting expressed as Spark jobs."""
