"""Training-data operators: one module each, and ``queries`` that registers them."""
