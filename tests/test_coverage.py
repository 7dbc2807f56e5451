"""The coverage table names functions that exist."""

import importlib
import re

from codestrata.plans.coverage import OPERATORS


def test_named_functions_exist():
    for ident, places in OPERATORS.items():
        module = None
        for part in places.split(", "):
            m = re.fullmatch(r"((?:\w+\.)+)?(\w+)", part)
            if not m or part.startswith(("api.", "plans.")):
                continue
            if m[1]:
                module = importlib.import_module("codestrata." + m[1].rstrip("."))
            if module:
                assert hasattr(module, m[2]), (ident, part)
