"""Dictionary-driven text segmentation and lexical analytics on Spark DataFrames."""
