"""Operators on event tables: structure, attributes, dictionaries, grammars."""
