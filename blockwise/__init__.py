"""blockwise: text detections in, audited records out, as Spark DataFrames."""
