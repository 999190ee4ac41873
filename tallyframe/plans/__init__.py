"""End-to-end recipes: feature tables, split and rebalance, training and scoring."""
