"""Value codecs and scalar functions as Column expressions; nothing here leaves the JVM."""
