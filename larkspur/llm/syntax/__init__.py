"""Parsing-expression grammars of programming languages and the packrat engine that runs them."""
