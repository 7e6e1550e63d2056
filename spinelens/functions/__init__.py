"""Scalar, array and geometry helpers.

Every helper takes SQL expression texts and returns one, for ``selectExpr`` or ``F.expr``: an
expression is parsed once in the JVM, where composing it from Column objects costs a gateway
call per node. All of them are Catalyst expressions; there is no UDF.
"""
