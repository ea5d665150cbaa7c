"""Credit-history feature engineering as DataFrame-to-DataFrame Spark operators."""
