"""Movement-network analytics expressed as Spark logical plans."""
