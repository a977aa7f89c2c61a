"""DataFrame operators: cleaning, folds, labels, recommenders, similarity, metrics, features."""
