"""A PySpark engine that evaluates long-form simultaneous translation, and prepares text corpora at scale."""
