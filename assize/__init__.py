"""Assize: auditing analytics over decision records, expressed as Spark DataFrames."""
