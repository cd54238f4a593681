from . import energy, ingest, inventory, sensors, waste, water  # noqa: F401  (they register their queries)
from . import stores, streams  # noqa: F401  (they register their queries)
from . import twins  # noqa: F401, I001  (last: it takes up the others)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
