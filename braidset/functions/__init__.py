"""Column functions: keys, text, timestamps and hashes. All run inside the JVM."""
