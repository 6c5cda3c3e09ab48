"""Table profiling, comparison and feed health on Spark DataFrames.

Every operator takes DataFrames and plain parameters and returns a DataFrame.
What is collected on the way has a bound that does not grow with the tables:
``find_references`` and ``mention_report`` fetch a row about their items, a sketch and a
Bloom filter, and the footer readers a row per table.
"""

from plumbline.operators import *  # noqa: F401,F403
from plumbline.operators import __all__ as _operators
from plumbline.session import build_session
from plumbline.sources import *  # noqa: F401,F403
from plumbline.sources import __all__ as _sources

__all__ = [*_operators, *_sources, "build_session"]
