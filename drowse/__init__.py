"""Event detection on fixed-rate sensor series, as Spark jobs."""
