"""Sources and sinks: files, office formats, code parsers, exports."""
