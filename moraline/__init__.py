"""Text conversion, word-level language modelling and corpus preparation on Spark."""
