"""Sources and sinks: archives, kline files, tick tables, reports."""
