"""Sources and sinks: CSV scan with contracts, fixture mapping, table writers."""
