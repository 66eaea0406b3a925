"""Every operator as a runnable query, with the SQL it is checked against."""
