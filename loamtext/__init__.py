"""loamtext: hierarchical text segmentation and its evaluation as Spark DataFrames."""
