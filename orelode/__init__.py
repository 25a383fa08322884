"""Analytics over technical-report corpora and portfolios on Spark."""
