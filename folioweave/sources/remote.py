"""Opt-in fetches on the driver, kept in a cache folder by the hash of their address. Executors never fetch."""

from __future__ import annotations

import hashlib
import urllib.request
from pathlib import Path

SCHEMA_SECONDS, PACKAGE_SECONDS = 5, 20


def fetch(address: str, cache: Path | None, seconds: float, suffix: str = "") -> bytes:
    at = cache / (hashlib.sha256(address.encode()).hexdigest() + suffix) if cache else None
    if at and at.exists():
        return at.read_bytes()
    with urllib.request.urlopen(address, timeout=seconds) as answer:  # noqa: S310  http(s) only, checked by the callers
        data = answer.read()
    if at:
        try:
            at.parent.mkdir(parents=True, exist_ok=True)
            at.write_bytes(data)
        except OSError:
            pass  # the cache is best effort
    return data


def schemas_of(refs: list[str], root: str, cache: Path | None = None, remote: bool = False) -> dict[str, dict | str | None]:
    """Schema documents by resolved path or web address, what is wrong where one can't be read, None where there is none; web addresses only if ``remote``."""
    from .readers import schema_document

    out: dict[str, dict | str | None] = {}
    for ref in refs:
        try:
            if ref.startswith(("http://", "https://")):
                out[ref] = schema_document(fetch(ref, cache, SCHEMA_SECONDS, ".json").decode()) if remote else None
            else:
                out[ref] = schema_document(Path(ref).read_text(encoding="utf-8"))
        except UnicodeDecodeError:
            out[ref] = "the schema document is no UTF-8"
        except (OSError, ValueError):
            out[ref] = None
    return out


def package_bytes(place: str, checksum: str | None, cache: Path | None = None) -> bytes:
    """An archive from a path or an address; an address needs a checksum."""
    if place.startswith(("http://", "https://")):
        if not checksum:
            raise ValueError("a package from an address needs a checksum")
        return fetch(place, cache, PACKAGE_SECONDS, ".zip")
    return Path(place).read_bytes()
