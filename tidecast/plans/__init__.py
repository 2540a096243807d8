"""End-to-end forecasts and the registered queries."""
