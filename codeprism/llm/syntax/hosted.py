"""Python: the host's own parser, which is written in C, is the grammar here."""

from __future__ import annotations

import symtable
import warnings


def python_valid(text: str) -> bool:
    """Whether ``text`` is a Python module; names, scopes and types do not matter."""
    import ast

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            symtable.symtable(text, "f", "exec")  # parses without building objects
            return True
        except (SyntaxError, ValueError, MemoryError, RecursionError, UnicodeError):
            pass
        try:
            ast.parse(text)  # what is wrong may be a rule about scopes
            return True
        except (SyntaxError, ValueError, UnicodeError):
            return False
        except (MemoryError, RecursionError):
            return True  # nested too deeply for the host, which is no error of syntax
