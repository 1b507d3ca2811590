"""Column functions: cleansing, conversion, validation and JSON access. All stay in the JVM."""
