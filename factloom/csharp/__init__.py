"""C# source text to facts: tokens, declarations, and a binder that works unit by unit."""
