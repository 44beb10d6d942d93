"""Payment-risk analytics on Spark: history features, rules, decisions and the learning loop."""
