"""All registered queries."""

from redactflow.plans import (  # noqa: F401
    file_queries,
    image_queries,
    queue_queries,
    record_queries,
    repair_queries,
    report_queries,
    stream_queries,
    text_queries,
)
from redactflow.plans.registry import REGISTRY

__all__ = ["REGISTRY"]
