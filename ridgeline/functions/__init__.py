"""Column expressions; every function takes and returns Columns unless it says otherwise."""
