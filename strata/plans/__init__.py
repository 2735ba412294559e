"""From SQL text to DataFrames: lexer, parser, names, types and lowering."""
