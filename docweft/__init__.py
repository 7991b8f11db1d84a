"""Document-intelligence engine on PySpark."""
