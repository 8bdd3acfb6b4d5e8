"""Is a source file valid under the grammar of its language? Lexers, local grammars, and their reduction."""
