"""Column functions: every helper takes and returns Spark columns."""
