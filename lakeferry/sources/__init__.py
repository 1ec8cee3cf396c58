"""Where rows come from: files, tables, SQL, JDBC, Arrow streams."""
