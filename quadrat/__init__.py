"""Analytics for visual-survey catalogues and pairwise judgments, as composable Spark DataFrame operators."""
