"""Plan patterns the operators are built from: blocks, as-of, quantiles, folds."""
