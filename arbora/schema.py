"""Record types, limits and result codes of a directory: a tree of categories with links attached."""

from __future__ import annotations

from pyspark.sql import types as T

_L, _S, _TS, _I = T.LongType(), T.StringType(), T.TimestampType(), T.IntegerType()

CATEGORY = T.StructType([T.StructField("id", _L), T.StructField("parent_id", _L), *(T.StructField(c, _S) for c in ("name", "slug", "description")), *(T.StructField(c, _L) for c in ("link_count", "child_count", "sort_order")), T.StructField("created_at", _TS), T.StructField("updated_at", _TS), T.StructField("link_count_subtree", _L), T.StructField("child_count_subtree", _L), T.StructField("flags", _I)])
LINK = T.StructType([T.StructField("id", _L), T.StructField("category_id", _L), *(T.StructField(c, _S) for c in ("url", "title", "description")), T.StructField("sort_order", _L), T.StructField("created_at", _TS), T.StructField("updated_at", _TS), T.StructField("status", _I), T.StructField("submitter_id", _L), *(T.StructField(c, _S) for c in ("editor_note", "tags", "language", "region", "license"))])
REPAIR_TASK = T.StructType([T.StructField("seq", _L), T.StructField("cat_id", _L), T.StructField("op", _I), T.StructField("created_at_ms", _L), T.StructField("old_slug_prefix", _S)])

# Byte limits, status numbers and paging caps.
LIMITS = {"category": {"name": 64, "slug": 128, "description": 1024}, "link": {"url": 64, "title": 128, "description": 256}}
PENDING, APPROVED, REJECTED = 0, 1, 2
PAGE_CAP, SEARCH_CAP, BATCH_CAP, MAX_OFFSET, DEFAULT_PAGE = 100, 50, 200, 5000, 50
MAX_DEPTH, MAX_HOPS, MAX_PATH_BYTES = 64, 256, 2048
# Result name -> (status, sub-status) of the wire protocol.
CODES = {
    "ok": (0, 0), "already_in_state": (0, 0), "not_found": (1, 0), "duplicate_url": (2, 7), "invalid": (3, 0), "field_too_long": (3, 1), "invalid_slug": (3, 2), "buffer_too_small": (3, 3),
    "path_too_deep": (3, 4), "unsupported_order": (3, 5), "offset_too_large": (3, 8), "already_in_progress": (4, 9), "category_not_found": (5, 0), "parent_not_found": (5, 6), "has_children": (6, 0), "circular_reference": (7, 0),
}
TOKEN_MIN, TOKEN_MAX, QUERY_MIN = 2, 64, 2


class DirectoryError(ValueError):
    """A request that the directory rejects as a whole: ``status`` names the reason."""

    def __init__(self, status: str, message: str = "") -> None:
        super().__init__(message or status)
        self.status = status
        self.code, self.sub_code = CODES.get(status, (4, 0))
