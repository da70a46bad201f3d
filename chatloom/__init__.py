"""chatloom: chat exports and message data on PySpark."""
