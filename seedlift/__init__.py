"""Entity prioritisation on Spark: annotation tables in, ranked entities out."""
