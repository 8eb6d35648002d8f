"""Discussion-signal analytics on Spark: entity mentions, scores, signals, outcomes and statistics as DataFrame operators."""
