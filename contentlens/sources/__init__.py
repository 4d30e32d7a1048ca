"""Sources and sinks: table snapshots, the driver-table views, the date spine."""
