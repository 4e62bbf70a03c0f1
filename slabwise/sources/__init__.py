"""Sources and sinks: corpora, binary segment files, compression."""
