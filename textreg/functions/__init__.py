"""Column functions: everything here maps Column to Column and stays in the JVM."""
