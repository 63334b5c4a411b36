"""docloom: document analytics on Spark's DataFrame API."""
