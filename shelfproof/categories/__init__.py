"""Category rules; importing this package registers the three categories."""

from shelfproof.categories import pasta, paste, rice  # noqa: F401
