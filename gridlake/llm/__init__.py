"""Training-data operators: ten self-contained DataFrame operators and the queries that apply them."""
