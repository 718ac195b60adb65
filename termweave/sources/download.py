"""Fetching dumps over HTTP: driver-side, resumable, idempotent. The one part of the engine that is no Spark job."""

from __future__ import annotations

import logging
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from pathlib import Path
from urllib.parse import urlsplit

from ..config import DUMPS, dump_url

log = logging.getLogger(__name__)
TRIES, PAUSE_S, TIMEOUT_S, CHUNK = 3, 5, 30, 1 << 20


def file_name(url: str) -> str:
    return urlsplit(url).path.rpartition("/")[2]


def remote_size(url: str, opener: Callable = urllib.request.urlopen) -> int | None:
    """What the server says; None if it doesn't."""
    try:
        with opener(urllib.request.Request(url, method="HEAD"), timeout=TIMEOUT_S) as answer:
            size = answer.headers.get("Content-Length")
    except (urllib.error.URLError, OSError):
        return None
    return int(size) if size and size.isdigit() else None


def complete(path: Path, size: int | None) -> bool:
    """Is the file there, as long as it should be?"""
    return size is not None and path.exists() and path.stat().st_size == size


def fetch(url: str, path: Path, opener: Callable = urllib.request.urlopen) -> bool:
    """True if the file is there in the end. A part that is there is gone on from, if the server agrees."""
    size = remote_size(url, opener)
    if complete(path, size):
        return True
    path.parent.mkdir(parents=True, exist_ok=True)
    have = path.stat().st_size if path.exists() else 0
    request = urllib.request.Request(url, headers={"Range": f"bytes={have}-"} if have else {})
    try:
        with opener(request, timeout=TIMEOUT_S) as answer, path.open("ab" if answer.status == 206 else "wb") as out:
            while block := answer.read(CHUNK):
                out.write(block)
    except urllib.error.HTTPError as e:
        log.warning("%s: %s", url, e)
        return False
    return size is None or path.stat().st_size == size


def fetch_retrying(url: str, path: Path, opener: Callable = urllib.request.urlopen, pause: float = PAUSE_S) -> bool:
    for n in range(TRIES):
        try:
            if fetch(url, path, opener):
                return True
        except OSError as e:
            log.warning("try %d of %s: %s", n + 1, url, e)
        if n + 1 < TRIES:
            time.sleep(pause)
    return False


def fetch_all(folder: str, opener: Callable = urllib.request.urlopen, pause: float = PAUSE_S) -> dict[str, str]:
    """dump -> OK or FAILED."""
    urls = {name: dump_url(name) for name in DUMPS}
    return {name: "OK" if fetch_retrying(url, Path(folder, file_name(url)), opener, pause) else "FAILED" for name, url in urls.items()}
