"""Sources and sinks: Parquet folders, JDBC databases, delimited text and spreadsheets, query histories, results."""
