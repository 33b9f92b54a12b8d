"""Training-data operators: ten stages that prepare a text corpus, and their queries."""
