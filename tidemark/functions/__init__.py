"""Scalar functions as Column expressions."""

from tidemark.functions.odds import *  # noqa: F403
from tidemark.functions.states import *  # noqa: F403
from tidemark.functions.text import *  # noqa: F403
from tidemark.functions.times import *  # noqa: F403
