"""The registered queries; importing a module here registers what it holds."""

from drawlake.plans import asked, builtins, calls, drawings, exports, hot, matching, ordering, reporting, screens, text, trees  # noqa: F401
from drawlake.plans.registry import REGISTRY

__all__ = ["REGISTRY"]
