"""Sources and sinks: files, lake tables, databases, brokers, HTTP; checkpoints and storage addresses."""
