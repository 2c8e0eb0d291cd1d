"""A Spark engine for an append-only record of promises and of the checks made on them."""
