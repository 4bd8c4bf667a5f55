"""Calls of model services."""

import json
import time
from urllib.error import HTTPError, URLError
from urllib.request import Request, urlopen

#: Attempts, and seconds before the second; each further wait is twice as long.
ATTEMPTS, WAIT = 4, 0.5


def post(url: str, body: dict, key: str | None = None, timeout: float = 60, attempts: int = ATTEMPTS, wait: float = WAIT) -> bytes:
    """The answer to a JSON body; connections that fail and answers 429 and 5xx are tried again."""
    head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
    for i in range(attempts):
        try:
            with urlopen(Request(url, json.dumps(body).encode(), head), timeout=timeout) as r:
                return r.read()
        except HTTPError as e:
            if i == attempts - 1 or not (e.code == 429 or e.code >= 500):
                raise
        except URLError:
            if i == attempts - 1:
                raise
        time.sleep(wait * 2**i)
    raise ValueError("attempts must be positive")
