"""cuelake: finding, fusing and scoring timestamped moments of long media on Spark."""
