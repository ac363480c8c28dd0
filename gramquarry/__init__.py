"""Byte-substring search over tables with n-gram indexes, expressed in Spark DataFrames."""
