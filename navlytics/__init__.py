"""navlytics: Spark DataFrame operators for navigation and mapping tables."""
