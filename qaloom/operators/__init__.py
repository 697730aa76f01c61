"""Table operators: each takes and returns DataFrames and stays lazy unless it says otherwise."""
