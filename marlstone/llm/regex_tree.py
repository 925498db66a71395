"""The parse tree of a regular expression.

Python keeps its parser in private modules that have moved before; this is the
one place that names them, and a test holds the kinds of nodes to what the
secret scan expects.
"""

from __future__ import annotations

import sys

if sys.version_info >= (3, 11):
    from re import _constants as op
    from re import _parser as parser
else:
    import sre_constants as op
    import sre_parse as parser

parse = parser.parse
__all__ = ["op", "parse"]
