"""renewlake: subscription-churn analytics as Spark DataFrame jobs."""
