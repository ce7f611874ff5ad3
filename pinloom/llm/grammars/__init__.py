"""Lexers and parsing-expression grammars, one module for each language."""
