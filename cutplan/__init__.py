"""cutplan: per-frame time series to cut plans, and training-data operators, on PySpark."""
