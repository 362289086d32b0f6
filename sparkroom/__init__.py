"""Raw-image and metadata analytics as Spark DataFrame operations."""
