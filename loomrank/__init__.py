"""A PySpark engine that matches, filters, scores and ranks documents."""
