"""The broadcast service's requests over a shared folder: what a server would do for each, without one.

The list of a broadcast (token, expiration, episodes) is a value in a store, so
requests are atomic commits; an episode is a folder that streams can read.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import log
from palimpsest.sources import store

#: Seconds that a broadcast lives, and an episode after it.
BROADCAST_SECONDS, EPISODE_SECONDS = 24 * 3600, 12 * 3600
LISTS = 7
METHODS = ("GET", "POST", "PUT", "DELETE", "OPTIONS")

Body = tuple[DataFrame, DataFrame]


class Service:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.store = store.Store(spark, f"{self.path}/lists")

    @property
    def episodes(self) -> str:
        return f"{self.path}/episodes"

    def _held(self, commits: list[dict], broadcast: str, now: int) -> dict | None:
        rows = self.store.rows(commits).where((F.col("slot") == LISTS) & (F.col("key") == broadcast))
        row = log.latest(rows).head()
        held = json.loads(row["value"]) if row else None
        return held if held and held["expiration"] > now else None

    def _put(self, broadcast: str, change, now: int) -> None:
        """Commits what `change` makes of the list there is; it is asked again if another request comes first."""

        def made(commits: list[dict], first: int) -> DataFrame:
            value = json.dumps(change(self._held(commits, broadcast, now)))
            return self.spark.createDataFrame([(LISTS, broadcast, value, False, now * 1000, first)], store.LOG)

        self.store.add(made)

    def handle(self, method: str, path: str, token: str | None = None, body: Body | None = None, now: int | None = None, episode: str | None = None) -> tuple[int, object]:
        """(status, answer) of a request.

        GET broadcast/<id> answers the sorted episodes, GET broadcast/<id>/<episode>
        its rows. POST broadcast makes a broadcast, with a first `episode` if one is
        given. PUT broadcast/<id>/<episode> stores one: 201 if it is new, 200 if it
        replaces one. DELETE broadcast/<id> empties the list; episodes stay until
        they expire. 400 for other paths or numbers, 401 for a wrong token, 404 for
        what isn't there or has expired, 405 for other methods.
        """
        now = int(time.time()) if now is None else now
        parts = path.strip("/").split("/")
        if parts[0] != "broadcast":
            return 400, None
        if method not in METHODS:
            return 405, None
        if method == "OPTIONS":
            return 200, None
        if len(parts) not in {"GET": (2, 3), "POST": (1,), "PUT": (3,), "DELETE": (2,)}[method]:
            return 400, None
        if method == "POST":
            return self._post(episode, body, now)
        broadcast = parts[1]
        held = self._held(self.store.commits(), broadcast, now)
        if method == "GET" and len(parts) == 3:
            return self._episode(broadcast, parts[2], now)
        if held is None:
            return 404, None
        if method == "GET":
            return 200, held["episodes"]
        if token != held["token"]:
            return 401, None
        if method == "DELETE":
            self._put(broadcast, lambda was: (was or held) | {"episodes": []}, now)
            return 200, None
        if not parts[2].isdecimal():
            return 400, None
        number = int(parts[2])
        self._write(broadcast, number, body)
        if number in held["episodes"]:
            return 200, None
        self._put(broadcast, lambda was: (was or held) | {"episodes": sorted({*(was or held)["episodes"], number})}, now)
        return 201, None

    def _post(self, episode: str | None, body: Body | None, now: int) -> tuple[int, object]:
        if episode is not None and not episode.isdecimal():
            return 400, None
        broadcast, token = str(uuid.uuid4()), str(uuid.uuid4())
        if episode is not None:
            self._write(broadcast, int(episode), body)
        told = {"token": token, "expiration": now + BROADCAST_SECONDS}
        self._put(broadcast, lambda was: told | {"episodes": [] if episode is None else [int(episode)]}, now)
        return 201, told | {"broadcast_id": broadcast}

    def _write(self, broadcast: str, number: int, body: Body | None) -> None:
        if body is None:
            raise ValueError("an episode needs nodes and edges")
        store.push_episode(*body, self.episodes, broadcast, number)

    def _episode(self, broadcast: str, number: str, now: int) -> tuple[int, object]:
        rows = self.store.read().where((F.col("slot") == LISTS) & (F.col("key") == broadcast))
        row = log.latest(rows).head()
        alive = row is not None and json.loads(row["value"])["expiration"] + EPISODE_SECONDS > now
        if not alive or not number.isdecimal() or f"{broadcast}-{int(number)}" not in self._folders():
            return 404, None
        return 200, self.spark.read.schema(store.EPISODE).parquet(f"{self.episodes}/{broadcast}-{int(number)}")

    def _folders(self) -> list[str]:
        return store.Store(self.spark, self.path)._names("episodes")
