"""brindle: a relational analytics engine on PySpark with its own compact SQL dialect."""
