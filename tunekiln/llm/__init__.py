"""Training-data operators for language models (one module per operator) and their queries."""
