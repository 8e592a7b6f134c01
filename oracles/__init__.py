"""Hand-written SQL that the Spark results are checked against."""
