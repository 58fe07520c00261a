"""tabulon: table-analytics operators as plain DataFrame -> DataFrame functions on Spark."""
