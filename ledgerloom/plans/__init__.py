"""Input tables and registered queries; the catalogue is loaded first, since all query modules register in it."""

from . import catalog  # noqa: F401
