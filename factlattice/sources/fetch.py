"""Fetching files for ingestion: a cache, retries, many at once. The engine itself reads landed files only."""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path


def retried(action: Callable[[], bytes], attempts: int = 4, pause: float = 3.0, wait: Callable[[float], None] = time.sleep) -> bytes:
    """The result of ``action``; timeouts and lost connections are tried again after ever longer pauses, an
    answer that says no isn't."""
    for attempt in range(1, attempts + 1):
        try:
            return action()
        except urllib.error.HTTPError:
            raise
        except (TimeoutError, ConnectionError, urllib.error.URLError):
            if attempt == attempts:
                raise
            wait(pause * attempt)
    raise ValueError("attempts must be 1 or more")


def download(url: str, timeout: float = 120) -> bytes:
    with urllib.request.urlopen(url, timeout=timeout) as answer:
        return answer.read()


def cached(base: str, name: str, folder: str | Path, get: Callable[[str], bytes] = download) -> bytes:
    """A file of a pinned release (``base`` names it): fetched once into the folder, then read from there."""
    local = Path(folder) / name
    if not local.exists():
        body = retried(lambda: get(f"{base}/{name}"))
        local.parent.mkdir(parents=True, exist_ok=True)
        part = local.with_suffix(local.suffix + ".part")
        part.write_bytes(body)
        part.rename(local)  # never a file that is cut short
    return local.read_bytes()


def all_of(jobs: Iterable[str], work: Callable[[str], object], workers: int = 24, passes: int = 3) -> tuple[dict[str, object], dict[str, Exception]]:
    """(results, failures) of ``work`` on each job, several at once. Equal jobs are done once; failed ones again
    in further passes, until none fails or none more succeeds."""
    done: dict[str, object] = {}
    failed: dict[str, Exception] = {}
    open_ = list(dict.fromkeys(jobs))

    def one(job: str) -> tuple[str, object, Exception | None]:
        try:
            return job, work(job), None
        except Exception as e:  # noqa: BLE001  the job's failure is its result
            return job, None, e

    for _ in range(passes):
        if not open_:
            break
        with ThreadPoolExecutor(workers) as pool:
            outcomes = list(pool.map(one, open_))
        failed = {job: e for job, _, e in outcomes if e is not None}
        done |= {job: value for job, value, e in outcomes if e is None}
        if len(failed) == len(open_):
            break
        open_ = list(failed)
    return done, failed
