"""Writers: staged and model tables, report CSVs, and small documents."""
