"""Writers: catalog tables, JDBC tables."""
