"""Analytics over circular-genome long reads, declared as Spark DataFrame plans."""
