"""DataFrame operators: windows, joins, rankings, ratings, folds, resampling."""
