"""Column expressions shared by every operator. All stay inside the JVM."""
