"""Tables of Parquet files under a transactional log in the open Delta format."""
