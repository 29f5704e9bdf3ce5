"""Analytics over tagged, expiring key/value data, and training-data operators, on Spark."""
