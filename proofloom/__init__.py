"""proofloom: evidence-backed case evaluation as plain PySpark DataFrame plans."""
