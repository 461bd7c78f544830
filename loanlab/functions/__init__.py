"""Column expressions (JVM-side, codegen-friendly): strings, dates, maths,
status predicates."""

from .expr import *  # noqa: F401,F403
