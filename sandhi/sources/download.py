"""Driver-side utilities: resumable download and extraction with a marker."""

from __future__ import annotations

import os
import tarfile
import urllib.error
import urllib.request


def download(url: str, path: str, timeout: float = 60.0, chunk: int = 1 << 20) -> str:
    """Fetch to path, going on from what is there; a server that cannot starts over, one that says the
    range is beyond the end has sent it all."""
    have = os.path.getsize(path) if os.path.exists(path) else 0
    req = urllib.request.Request(url, headers={"Range": f"bytes={have}-"} if have else {})
    try:
        with urllib.request.urlopen(req, timeout=timeout) as r, open(path, "ab" if have and r.status == 206 else "wb") as f:
            while data := r.read(chunk):
                f.write(data)
    except urllib.error.HTTPError as e:
        if e.code != 416:
            raise
    return path


def extract(archive: str, to: str) -> str:
    """Unpack once: a marker written last tells that all of it is there."""
    marker = os.path.join(to, "." + os.path.basename(archive) + ".done")
    if not os.path.exists(marker):
        os.makedirs(to, exist_ok=True)
        with tarfile.open(archive) as t:
            t.extractall(to, filter="data")
        open(marker, "w").close()
    return to
