"""The queries the driver runs: SPARK holds the functions, SQL what they must equal."""
