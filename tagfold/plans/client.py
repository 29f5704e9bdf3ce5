"""The client's verbs as calls on one session and page store: mutations append commands, queries fold what was appended.

A client holds the commands of one script, as a driver program writes them; the state before them may be any DataFrame.
Arguments are coerced as clients do: a lifetime of None is infinite and False the default, tags may be a single string.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagfold.functions import lifetimes as L
from tagfold.functions import scalars
from tagfold.operators import config, pages, sessions, stats, tags
from tagfold.sources import snapshots

PAGE_LOG = "seq long, ts long, id string, ua int, op string, lifetime long, tags array<string>, usize long, mode string"
SESSION_LOG = "seq long, ts long, id string, ua int, op string, lifetime long, request_id long"
#: Modes of a clean-up, as clients number them.
MODES = ("all", "old", "matchall", "matchnot", "matchany")
CAPABILITIES = {"automatic_cleaning": True, "tags": True, "expired_read": False, "priority": False, "infinite_lifetime": True, "get_list": True}


def lifetime_of(value: int | bool | None) -> int:
    """Seconds that a client's argument asks for: a number, False for the default (-1), None for no end (0)."""
    return 0 if value is None else -1 if value is False else int(value)


def tags_of(value: str | Iterable[str] | None) -> list[str]:
    """A list of tags from a list, a single tag or nothing."""
    return [] if value is None else [value] if isinstance(value, str) else list(value)


class Client:
    def __init__(self, spark: SparkSession, now: int, ua: int = L.USER, page_state: DataFrame | None = None, always: bool = True):
        self.spark, self.now, self.ua, self.before, self.always = spark, now, ua, page_state, always
        self.page_rows: list[tuple] = []
        self.session_rows: list[tuple] = []
        self.settings: list[tuple[int, str, str]] = []
        self.lines: list[tuple[int, str]] = []
        self.last_error: str | None = None

    # logs and states
    def page_log(self) -> DataFrame:
        return self.spark.createDataFrame(self.page_rows, PAGE_LOG)

    def session_log(self) -> DataFrame:
        return self.spark.createDataFrame(self.session_rows, SESSION_LOG)

    def page_state(self) -> DataFrame:
        return pages.states(self.page_log(), snapshots.saved(self.spark, "client"), self.before, always=self.always).where("alive")

    def session_state(self) -> DataFrame:
        return sessions.live(self.session_log(), always=self.always)

    def _page(self, op: str, name: str | None = None, lifetime: int | None = None, given: list[str] | None = None, usize: int | None = None, mode: str | None = None) -> bool:
        if name is not None and not 0 < len(name.encode()) < 1 << 16:
            return self._fail(f"{op}: bad name")
        self.page_rows.append((len(self.page_rows), self.now, name, self.ua, op, lifetime, given, usize, mode))
        return True

    def _session(self, op: str, name: str, lifetime: int | None = None, request: int = 0) -> bool:
        if not 0 < len(name.encode()) < 1 << 16:
            return self._fail(f"{op}: bad name")
        self.session_rows.append((len(self.session_rows), self.now, name, self.ua, op, lifetime, request))
        return True

    def _fail(self, text: str) -> bool:
        self.last_error = text
        return False

    # sessions
    def read(self, name: str, request: int = 0) -> bool:
        return self._session("READ", name, request=request)

    def write(self, name: str, lifetime: int | bool | None, data: str, request: int = 0) -> bool:
        return self._session("WRITE", name, lifetime_of(lifetime), request)

    def destroy(self, name: str) -> bool:
        return self._session("DESTROY", name)

    def gc(self, seconds: int) -> DataFrame:
        """The sessions that a garbage collection would delete now."""
        from tagfold.operators import eviction

        return eviction.collectable(self.session_state(), F.col("mtime") + seconds < self.now, L.SESSION_RETAIN).select("id")

    # pages
    def save(self, name: str, lifetime: int | bool | None, given: str | Iterable[str] | None, data: str) -> bool:
        return self._page("SAVE", name, lifetime_of(lifetime), tags_of(given), len(data.encode()))

    def load(self, name: str) -> bool:
        return self._page("LOAD", name)

    def test(self, name: str) -> DataFrame:
        found = self.page_state().where(F.col("id") == name).select("mtime")
        self._page("TEST", name)
        return found

    def touch(self, name: str, extra: int) -> bool:
        return self._page("TOUCH", name, int(extra))

    def remove(self, name: str) -> bool:
        return self._page("REMOVE", name)

    def clean(self, mode: str, given: str | Iterable[str] | None = None) -> bool:
        if mode not in MODES:
            return self._fail(f"CLEAN: no mode {mode}")
        return self._page("CLEAN", None, None, tags_of(given), None, mode)

    # queries
    def get_ids(self) -> DataFrame:
        return tags.ids(self.page_state())

    def get_tags(self) -> DataFrame:
        return tags.tags(self.page_state())

    def get_ids_matching_tags(self, given: str | Iterable[str]) -> DataFrame:
        return tags.matching(self.page_state(), tags_of(given))

    def get_ids_not_matching_tags(self, given: str | Iterable[str]) -> DataFrame:
        return tags.not_matching(self.page_state(), tags_of(given))

    def get_ids_matching_any_tags(self, given: str | Iterable[str]) -> DataFrame:
        return tags.matching_any(self.page_state(), tags_of(given))

    def get_metadatas(self, name: str) -> DataFrame:
        return tags.metadatas(self.page_state(), [name])

    def get_filling_percentage(self, quota: int) -> DataFrame:
        return stats.filling(self.page_state(), quota)

    def get_capabilities(self) -> dict[str, bool]:
        return dict(CAPABILITIES)

    # administration
    def ping(self) -> bool:
        return True

    def check(self, answers: DataFrame, metrics: DataFrame, limits: dict[str, tuple[str, int]], load: int) -> DataFrame:
        return stats.check(answers, metrics, limits, load)

    def info(self, quotas: dict[str, int | None]) -> DataFrame:
        return stats.info_lines({"FPC": self.page_state(), "Session": self.session_state().withColumn("usize", F.lit(0).cast("long"))}, quotas)

    def stats(self, mask: str = "*", domains: int = 7) -> DataFrame:
        return stats.wildcard(config.counters(self.spark).where(F.col("domains").bitwiseAND(domains) != 0), config.masks(self.spark, [mask])).select("name", "domains")

    def get(self, *masks: str) -> DataFrame:
        own = config.latest(self.spark.createDataFrame(self.settings, "seq int, name string, value string"))
        shipped = config.options(self.spark).join(own.select("name"), "name", "left_anti")
        return stats.wildcard(shipped.unionByName(own), config.masks(self.spark, list(masks))).select("name", "value")

    def set(self, name: str, value: object) -> bool:
        text = str(value).lower() if isinstance(value, bool) else str(value)
        self.settings.append((len(self.settings), name, text))
        return True

    def remote_config(self, path: str) -> bool:
        """Sets what a file of "name value" lines says."""
        for line in sorted(snapshots.config_lines(self.spark, path).collect()):
            self.set(line["name"], line["value"])
        return True

    local_config = remote_config

    def store(self, path: str, min_ua: int = 0) -> str:
        return snapshots.store_all(self.session_state(), self.page_state(), path, self.now, min_ua)

    def restore(self, path: str) -> bool:
        self.before = pages.known(snapshots.restore_fpc(self.spark, f"{path}/domain=fpc", self.now))
        self.page_rows.clear()
        return True

    def log(self, text: str) -> bool:
        self.lines.append((self.now, text))
        return True

    def logged(self) -> DataFrame:
        lines = self.spark.createDataFrame(self.lines, "ts long, text string")
        return lines.select(F.concat(scalars.shown_time(F.col("ts")), F.lit(" "), F.col("text")).alias("line"))

    def rotate(self, template: str) -> DataFrame:
        return self.spark.range(1).select(scalars.rotated(F.lit(template), F.lit(self.now)).alias("name"))

    def shutdown(self) -> None:
        self.page_rows.clear()
        self.session_rows.clear()

    def get_last_error(self) -> str | None:
        return self.last_error
