"""Sources and sinks: file listings, change detection, chunkers, chat lines and output forms."""
