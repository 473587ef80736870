"""Training-data operators: ten large-corpus operations and the queries that apply them."""
