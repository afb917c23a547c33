"""Aircraft and vessel surveillance data on Spark."""
