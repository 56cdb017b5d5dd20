"""tidewater: event-time, change-log and behaviour analytics on Spark DataFrames."""
