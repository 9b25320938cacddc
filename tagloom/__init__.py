"""tagloom: source-code tag analytics on PySpark."""
