"""Token tables, structured linguistic analysis and its scorers as Spark DataFrame transforms."""
