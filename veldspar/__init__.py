"""A read-only analytics engine on PySpark: a controlled SQL facade over declared sources."""
