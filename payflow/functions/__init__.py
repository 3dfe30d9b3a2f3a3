"""Column expressions. Every function returns a ``Column``; nothing here runs a job."""

from payflow.functions.core import *  # noqa: F401,F403
