"""Sources and sinks: directory scans, record formats, archives and object stores."""
