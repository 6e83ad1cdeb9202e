"""Sources: table scans, derived fixture tables and landed-payload parsers."""
