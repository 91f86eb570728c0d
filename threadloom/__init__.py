"""threadloom: identity resolution over time-ordered detections, on PySpark."""
