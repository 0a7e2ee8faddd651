"""Fetching from a paged HTTP service: the parts that need no network are plain functions.

``fetch_pages`` takes the function that posts a query, so tests (and clusters
without network) give their own.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterable, Sequence

PAGE = 500


def field_query(fields: Sequence[str], where: str | None = None, limit: int = PAGE, offset: int = 0, sort: str | None = "id asc") -> str:
    """A query body of the form ``fields a,b; where ...; sort ...; limit n; offset m;``."""
    parts = ["fields " + ",".join(dict.fromkeys(fields))]
    if where:
        parts.append(f"where {where}")
    if sort:
        parts.append(f"sort {sort}")
    parts += [f"limit {limit}", f"offset {offset}"]
    return "; ".join(parts) + ";"


def id_batches(ids: Iterable[int], size: int = PAGE) -> list[list[int]]:
    ids = sorted(set(ids))
    return [ids[k : k + size] for k in range(0, len(ids), size)]


def fetch_pages(post: Callable[[str], list[dict]], fields: Sequence[str], ids: Iterable[int] | None = None, page: int = PAGE, pause: float = 0.26, sleep: Callable[[float], None] = time.sleep) -> list[dict]:
    """All rows of a table, or those of some ids: one row per id, by id."""
    rows: dict[int, dict] = {}
    if ids is not None:
        for batch in id_batches(ids, page):
            for r in post(field_query(fields, f"id = ({','.join(map(str, batch))})", page)):
                rows.setdefault(r["id"], r)
            sleep(pause)
    else:
        offset = 0
        while True:
            got = post(field_query(fields, None, page, offset))
            for r in got:
                rows.setdefault(r["id"], r)
            if len(got) < page:
                break
            offset += page
            sleep(pause)
    return [rows[k] for k in sorted(rows)]


def with_retry(send: Callable[[str, str], tuple[int, list[dict]]], token: Callable[[], str], tries: int = 2) -> Callable[[str], list[dict]]:
    """A post function that takes a fresh token when the service answers 401."""

    def post(body: str) -> list[dict]:
        own = token()
        for _ in range(tries):
            status, rows = send(body, own)
            if status != 401:
                if status >= 400:
                    raise RuntimeError(f"status {status}")
                return rows
            own = token()
        raise RuntimeError("not authorised")

    return post


class Client:
    """Posts queries to ``url`` with a client id and a token that is fetched when it is absent, old or refused.

    Requests keep ``pause`` seconds apart.  ``opener`` opens a request (urllib's, unless a test gives its own).
    """

    def __init__(self, url: str, token_url: str, client_id: str, secret: str, pause: float = 0.26, opener: Callable = urllib.request.urlopen, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.url, self.token_url, self.client_id, self.secret, self.pause = url, token_url, client_id, secret, pause
        self.opener, self.clock, self.sleep = opener, clock, sleep
        self._token, self._until, self._last = "", float("-inf"), float("-inf")

    def token(self) -> str:
        """The token; a new one within a minute of its end."""
        if self.clock() >= self._until - 60:
            form = {"client_id": self.client_id, "client_secret": self.secret, "grant_type": "client_credentials"}
            with self.opener(urllib.request.Request(self.token_url, urllib.parse.urlencode(form).encode())) as answer:
                got = json.loads(answer.read())
            self._token, self._until = got["access_token"], self.clock() + got.get("expires_in", 3600)
        return self._token

    def send(self, body: str, token: str) -> tuple[int, list[dict]]:
        """One request, not before the pause since the last: its status and rows.  A refused token is dropped."""
        self.sleep(max(0.0, self._last + self.pause - self.clock()))
        self._last = self.clock()
        headers = {"Client-ID": self.client_id, "Authorization": f"Bearer {token}"}
        try:
            with self.opener(urllib.request.Request(self.url, body.encode(), headers)) as answer:
                return answer.status, json.loads(answer.read())
        except urllib.error.HTTPError as e:
            if e.code == 401:
                self._until = float("-inf")
            return e.code, []

    def post(self, body: str) -> list[dict]:
        return with_retry(self.send, self.token)(body)
