"""Stateful operators over streams of fragments, responses and items.

The batch forms are in ``operators.health`` and ``operators.search``; these keep the same quantities as state of each
page or domain.  Each wants ``order`` to rise within a micro-batch group; groups are sorted before use.  With ``idle`` (milliseconds) the state of a
page or domain that nothing came for in that time is dropped.  Every operator takes its settings as arguments, or from a ``CrawlConfig``.
"""

from __future__ import annotations

import codecs
import pickle
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from rscframe.kernel.flight import Page, dumps, leaves
from rscframe.operators.search import has_all, item_identity
from rscframe.operators.tables import equality_key

MAX_BYTES, CHECK_INTERVAL = 10_000_000, 8_192


def kept(groups, start: Callable[[], tuple], step: Callable[..., tuple[tuple, list]], names: list[str], schema: str, order: str, idle: int | None) -> DataFrame:
    """One state a group, pickled: ``step(key, state, rows in order)`` gives the next state and the rows out."""

    def run(key, parts, state):
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([], columns=names)
            return
        now, out = pickle.loads(state.get[0]) if state.exists else start(), []
        for pdf in parts:
            now, rows = step(key[0], now, pdf.sort_values(order).itertuples(index=False))
            out += rows
        state.update((pickle.dumps(now),))
        if idle:
            state.setTimeoutDuration(idle)
        yield pd.DataFrame(out, columns=names)

    return groups.applyInPandasWithState(run, schema, "state binary", "append", GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout)


class Buffer:
    """A page as far as it came: decoded text, bytes of a cut character, what was given out, and when it was last read."""

    __slots__ = ("text", "pending", "size", "read_at", "seen", "done")

    def __init__(self):
        self.text, self.pending, self.size, self.read_at, self.seen, self.done = "", b"", 0, 0, set(), False

    def __reduce__(self):
        return _buffer, tuple(getattr(self, s) for s in self.__slots__)

    def feed(self, raw: bytes, most: int, encoding: str) -> None:
        if self.done or self.size >= most:
            return
        decoder = codecs.getincrementaldecoder(encoding)("replace")
        decoder.setstate((self.pending, 0))
        part = raw[: most - self.size]
        self.text += decoder.decode(part)
        self.pending = decoder.getstate()[0]
        self.size += len(part)

    @property
    def ended(self) -> bool:
        return "</html>" in self.text[-2000:].lower()

    def due(self, interval: int, most: int) -> bool:
        """Whether enough came since the last reading, or nothing more will."""
        return not self.done and bool(self.text) and (self.size - self.read_at >= interval or self.ended or self.size >= most)


def _buffer(*values) -> Buffer:
    out = Buffer()
    for name, v in zip(Buffer.__slots__, values):
        setattr(out, name, v)
    return out


def rows_as_they_arrive(fragments: DataFrame, max_bytes: int = MAX_BYTES, keys: list[str] | None = None, encoding: str = "utf-8", check_interval: int = 1, idle: int | None = None, config=None) -> DataFrame:
    """Chunks of pages that arrive in pieces: fragments(page_id, frag_idx, bytes) -> page_id, chunk_key, kind, value_json, is_match.

    A chunk is given once it is complete (another row follows, or the text holds its closing tag).  A
    reference to a row that has not come is null.  Pieces may cut characters.  A page is read again only when ``check_interval`` bytes came since, or
    at its end.  With ``keys``, the first object with all of them, wherever it is nested, is a match (its row has ``is_match``) and the page is
    done; more pieces, and pieces beyond ``max_bytes``, are dropped.
    """
    if config is not None:
        max_bytes, keys, encoding, check_interval = config.stream_max_bytes, list(config.stream_keys) or None, config.stream_encoding, config.stream_check_interval
    test = has_all(keys) if keys else None

    def step(page_id, now: Buffer, rows) -> tuple[Buffer, list]:
        for r in rows:
            now.feed(bytes(r.bytes), max_bytes, encoding)
        out: list = []
        if not now.due(check_interval, max_bytes):
            return now, out
        now.read_at = now.size
        page = Page(now.text, missing_null=True)
        names = list(page.rows)
        whole = names if now.ended or now.size >= max_bytes else names[:-1]
        for name in whole:
            if name not in now.seen:
                now.seen.add(name)
                out.append((page_id, name, page.rows[name][2], dumps(page.resolve(name)), False))
        if test is not None:
            known = set(whole)
            found = next(((source, v) for _, source, _, v in page.objects() if source in known and test(v)), None)
            if found is not None:
                out.append((page_id, found[0], "match", dumps(found[1]), True))
                now.done, now.text, now.pending = True, "", b""
        return now, out

    return kept(fragments.groupBy("page_id"), Buffer, step, ["page_id", "chunk_key", "kind", "value_json", "is_match"], "page_id long, chunk_key string, kind string, value_json string, is_match boolean", "frag_idx", idle)


def throttle_steps(log: DataFrame, window: int = 20, least: float = 0.7, factor: float = 2.0, idle: int | None = None, config=None) -> DataFrame:
    """domain, seq, rolling, throttled, step, delay_factor: edges of throttling, by domain."""
    if config is not None:
        window, least, factor = config.throttle_window, config.throttle_min_confidence, config.throttle_factor

    def step(domain, now, rows):
        recent, on = now
        out = []
        for r in rows:
            if r.n_chunks <= 0:
                continue
            recent.append(r.score)
            mean = sum(recent) / len(recent)
            low = len(recent) >= max(3, window // 2) and mean < least
            if low != on:
                out.append((domain, r.seq, mean, low, "enter" if low else "leave", factor if low else 1 / factor))
            on = low
        return (recent, on), out

    names = ["domain", "seq", "rolling", "throttled", "step", "delay_factor"]
    return kept(log.groupBy("domain"), lambda: (deque(maxlen=window), False), step, names, "domain string, seq long, rolling double, throttled boolean, step string, delay_factor double", "seq", idle)


def drift_signals(log: DataFrame, min_samples: int = 5, threshold: float = 0.3, idle: int | None = None, config=None) -> DataFrame:
    """domain, seq, mean_before, score where a response falls far below the mean of those before."""
    if config is not None:
        min_samples, threshold = config.drift_min_samples, config.drift_threshold

    def step(domain, now, rows):
        n, total = now
        out = []
        for r in rows:
            if r.n_chunks <= 0:
                continue
            if n >= min_samples and total / n - r.score >= threshold:
                out.append((domain, r.seq, total / n, r.score))
            n, total = n + 1, total + r.score
        return (n, total), out

    return kept(log.groupBy("domain"), lambda: (0, 0.0), step, ["domain", "seq", "mean_before", "score"], "domain string, seq long, mean_before double, score double", "seq", idle)


def on_signal(signals: DataFrame, *handlers: Callable[..., None], **options: str):
    """Starts the stream; every handler is called with each signal's columns as keywords, on the driver, in order of arrival within a micro-batch.

    Signals are few by their nature (a domain's drift); they are read one partition at a time.
    """

    def call(batch: DataFrame, _: int) -> None:
        for row in batch.toLocalIterator():
            for handler in handlers:
                handler(**row.asDict())

    return signals.writeStream.options(**options).foreachBatch(call).start()


def unseen_items(items: DataFrame, keys: list[str] | None = None, item: str = "item_json", watermark: tuple[str, str] | None = None, config=None) -> DataFrame:
    """Items whose value (or key values) did not come before; a watermark (column, delay) bounds the state.  What is no object passes."""
    if config is not None:
        keys = list(config.dedupe_keys) or None
        if not config.dedupe_across_pages:
            return items
    rows = items.withColumn("_same", item_identity(F.col(item), keys))
    if watermark:
        rows = rows.withWatermark(*watermark)
    objects = rows.where("_same is not null")
    first = objects.dropDuplicatesWithinWatermark(["_same"]) if watermark else objects.dropDuplicates(["_same"])
    return first.union(rows.where("_same is null")).drop("_same")


def changes(page_id, seq, old: dict, new: dict) -> Iterator[tuple]:
    for p in new.keys() | old.keys():
        if p not in old or p not in new:
            yield page_id, seq, p, "added" if p in new else "removed"
        elif new[p] is None or new[p] != old[p]:
            yield page_id, seq, p, "changed"


def watched(pages: DataFrame, id_key: str | None = None, idle: int | None = None) -> DataFrame:
    """Changes of each page against its version before: pages(page_id, seq, html) -> page_id, seq, path, change."""

    def step(page_id, old, rows):
        out = []
        for r in rows:
            new = {p: equality_key(v) for p, v in leaves(Page(r.html).resolve_all(), id_key)}
            if old is not None:
                out += changes(page_id, r.seq, old, new)
            old = new
        return old, out

    return kept(pages.groupBy("page_id"), lambda: None, step, ["page_id", "seq", "path", "change"], "page_id long, seq long, path string, change string", "seq", idle)
