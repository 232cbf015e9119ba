"""docflow: document analytics on PySpark."""
