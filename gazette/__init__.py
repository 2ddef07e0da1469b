"""Binary classification of news text as composable Spark DataFrame jobs."""
