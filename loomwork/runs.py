"""What a long-running job on the driver needs: retries, one run at a time, resuming, and a look at memory."""

from __future__ import annotations

import hashlib
import json
import os
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from pathlib import Path


class Busy(Exception):
    """Another run of the same name is alive."""


def retried(f: Callable, attempts: int = 5, first_wait: float = 70.0, again: Callable[[Exception], bool] = lambda e: True, sleep: Callable[[float], None] = time.sleep):
    """What ``f`` returns; after an error that may pass it is tried again, each wait twice as long as the last."""
    for k in range(attempts):
        try:
            return f()
        except Exception as e:
            if k == attempts - 1 or not again(e):
                raise
            sleep(first_wait * 2**k)


def run_hash(settings: dict) -> str:
    """A name for a run: the same settings in any order give the same one."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True, default=str).encode()).hexdigest()[:16]


@contextmanager
def locked(path: str | os.PathLike, stale: float = 900.0, now: Callable[[], float] = time.time) -> Iterator[Callable[[], None]]:
    """Holds a lock file and gives the function that shows that the run is alive.

    A lock whose last sign of life is older than ``stale`` seconds is taken over.
    """
    path = Path(path)
    for _ in range(2):
        try:
            os.close(os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY))
            break
        except FileExistsError:
            with suppress(FileNotFoundError):
                if now() - path.stat().st_mtime <= stale:
                    raise Busy(str(path)) from None
                path.unlink()
    else:
        raise Busy(str(path))
    beat = lambda: os.utime(path, (now(), now()))
    beat()
    try:
        yield beat
    finally:
        path.unlink(missing_ok=True)


def save_state(path: str | os.PathLike, state: dict) -> None:
    """Writes the state of a run; the one before stays beside it until the new one is whole."""
    path = Path(path)
    fresh = path.with_suffix(".new")
    fresh.write_text(json.dumps(state))
    if path.exists():
        os.replace(path, path.with_suffix(".bak"))
    os.replace(fresh, path)


def load_state(path: str | os.PathLike) -> dict | None:
    """The last whole state, or None."""
    path = Path(path)
    for p in (path, path.with_suffix(".bak")):
        with suppress(OSError, ValueError):
            return json.loads(p.read_text())
    return None


def used_memory() -> int:
    """Bytes of memory that this process holds."""
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE")


def over_memory(limit: int, share: float = 0.8) -> bool:
    """Whether this process holds more than a share of what it may."""
    return used_memory() > share * limit


def worker_count(cpus: int | None = None, share: float = 0.4) -> int:
    """Workers of a fan-out on one machine; on a cluster the executors are the fan-out."""
    return max(1, -(-int((cpus or os.cpu_count() or 1) * share * 1000) // 1000))
