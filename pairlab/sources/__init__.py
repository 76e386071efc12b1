"""Sources and sinks: file scans, strict readers, validated and idempotent publishing."""
