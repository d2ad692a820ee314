"""Analytics over task ledgers, as Spark DataFrame plans."""
