"""Series operators: DataFrame to DataFrame, lazy, keyed by series_key."""
