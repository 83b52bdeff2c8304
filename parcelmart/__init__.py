"""Order-fulfilment and customer-experience analytics as PySpark DataFrame operators."""
