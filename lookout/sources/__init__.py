"""Sources and sinks: tables, JDBC options, GeoPackage reader, hit writer."""
