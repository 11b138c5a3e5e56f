"""Turn collections of files and web pages into curated, analysis-ready content on Spark."""

from .errors import (
    ContextFrameError,
    CustomError,
    InvalidCache,
    InvalidConfiguration,
    InvalidHeaderName,
    InvalidHeaderValue,
    MalformedState,
    Unsupported,
)
from .options import (
    AiAugmentOptions,
    ContentMapOptions,
    ContentSource,
    FetchOptions,
    LocalContentSource,
    ProcessContentOptions,
    SanitizeOptions,
    WebsiteContentSource,
)
from .streaming.progress import ProcessProgress, ProcessQuery, ProcessStateSnapshot, ProgressReceiver
from .workflow import ProcessContentHandle, ProcessContentOutput, ProcessFailure, ProcessItem, ProcessStage, process_content

__all__ = [
    "AiAugmentOptions",
    "ContentMapOptions",
    "ContentSource",
    "ContextFrameError",
    "CustomError",
    "FetchOptions",
    "InvalidCache",
    "InvalidConfiguration",
    "InvalidHeaderName",
    "InvalidHeaderValue",
    "LocalContentSource",
    "MalformedState",
    "ProcessContentHandle",
    "ProcessContentOptions",
    "ProcessContentOutput",
    "ProcessFailure",
    "ProcessItem",
    "ProcessProgress",
    "ProcessQuery",
    "ProcessStage",
    "ProcessStateSnapshot",
    "ProgressReceiver",
    "SanitizeOptions",
    "Unsupported",
    "WebsiteContentSource",
    "process_content",
]
