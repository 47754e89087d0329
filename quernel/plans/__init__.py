"""From syntax trees to Spark plans: expressions as SQL text, queries as DataFrames."""
