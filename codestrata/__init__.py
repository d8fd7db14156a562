"""A code-intelligence index and analytics engine expressed as Spark plans."""
