"""Caption models in NumPy, run behind Arrow batches."""
