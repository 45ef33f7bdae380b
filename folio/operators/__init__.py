"""Table operators: DataFrame in, DataFrame out; rules, thresholds and dates are parameters."""
