"""A description of an HTTP request; building one does no input or output."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from ..errors import InvalidHeaderName, InvalidHeaderValue

_NAME = re.compile(r"[!#$%&'*+.^_`|~0-9A-Za-z-]+\Z")
_VALUE = re.compile(r"[\t\x20-\x7e\x80-\xff]*\Z")


def _header(name: str, value: str) -> tuple[str, str]:
    if not _NAME.match(name):
        raise InvalidHeaderName(name)
    if not _VALUE.match(value):
        raise InvalidHeaderValue(value)
    return name.lower(), value


@dataclass(frozen=True)
class WebRequest:
    url: str
    headers: tuple[tuple[str, str], ...] = field(default=())
    params: tuple[tuple[str, str], ...] = field(default=())

    def with_headers(self, headers) -> WebRequest:
        return replace(self, headers=tuple(_header(*h) for h in headers))

    def append_header(self, name: str, value: str) -> WebRequest:
        return replace(self, headers=(*self.headers, _header(name, value)))

    def with_params(self, params) -> WebRequest:
        return replace(self, params=tuple(params))

    def append_param(self, name: str, value: str) -> WebRequest:
        return self.append_params([(name, value)])

    def append_params(self, params) -> WebRequest:
        return replace(self, params=(*self.params, *params))
