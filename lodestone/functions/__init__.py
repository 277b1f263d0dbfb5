"""Column functions over markup, titles and tokens; all run inside the JVM unless they say otherwise."""
