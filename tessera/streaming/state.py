"""Keyed state of the streams: plans of users, stories of a title, stories of a label.

State lives in the state store, one entry an item, and is asked for by item; nothing that a key holds is written back whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PLAN = "user_id long, items string, version long"


class Plan(StatefulProcessor):
    """The plan of a user from toggles that come in any order (user_id, item, action, seq, at).

    An item's last word stands beside its place in the order; the last emptying is one number. A place is twice the seq, and one
    more for what fills a plan, so that a replacement's own items come after its emptying. A dropped item is kept only until the
    watermark has passed its time: no older toggle can come then.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getMapState("last", "item long", "place long, on boolean, at long")
        self.reset = handle.getValueState("reset", "place long, version long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows))
        reset, version = self.reset.get() if self.reset.exists() else (-1, 0)
        empties = batch["action"].isin(["clear", "replace"])
        reset = max(reset, int((2 * batch.loc[empties, "seq"]).max()) if empties.any() else -1)
        self.reset.update((reset, version + 1))
        words = batch[(batch["action"] != "clear") & (2 * batch["seq"] + 1 > reset)].sort_values("seq").drop_duplicates("item", keep="last")
        for item, action, seq, at in zip(words["item"].tolist(), words["action"].tolist(), words["seq"].tolist(), words["at"].tolist(), strict=True):
            place = 2 * seq + 1
            if not self.last.containsKey((item,)) or self.last.getValue((item,))[0] < place:
                self.last.updateValue((item,), (place, action != "drop", at))
                if action == "drop":
                    self.handle.registerTimer(at * 1000)
        stars, gone = [], []
        for (item,), (place, on, _) in self.last.iterator():
            if place < reset:
                gone.append(item)
            elif on:
                stars.append(item)
        for item in gone:
            self.last.removeKey((item,))
        yield pd.DataFrame({"user_id": [key[0]], "items": [",".join(map(str, sorted(stars)))], "version": [version + 1]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        over = expiredTimerInfo.getExpiryTimeInMs() // 1000
        for item in [i for (i,), (_, on, at) in self.last.iterator() if not on and at <= over]:
            self.last.removeKey((item,))
        yield from ()

    def close(self) -> None:
        pass


STORY = "title_key string, version long, label string, id long, key string, t long, tags string, live boolean"


class Title(StatefulProcessor):
    """The story of a title (title_key, id, label, key, t, tags): the newest of its items with the tags of all.

    Every item leaves when the watermark passes its time. Each change comes out as a row with a rising version; where a title
    ends or moves to another label, a row that isn't live goes to the old one first. The version of a title that has ended is
    forgotten after ``REMEMBERED`` more.
    """

    REMEMBERED = 7 * 86_400_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.items = handle.getMapState("items", "id long", "t long, label string, key string, tags string")
        self.shown = handle.getValueState("shown", "version long, label string, id long, key string, t long, tags string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        over = timerValues.getCurrentWatermarkInMs()
        for batch in rows:
            for i, t, label, address, tags in zip(*(batch[c].tolist() for c in ("id", "t", "label", "key", "tags")), strict=True):
                if t * 1000 > over:
                    self.items.updateValue((i,), (t, label, address, tags))
                    self.handle.registerTimer(t * 1000)
        yield from self._changes(key, over)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        over = expiredTimerInfo.getExpiryTimeInMs() // 1000
        gone = [i for (i,), (t, *_) in self.items.iterator() if t <= over]
        for i in gone:
            self.items.removeKey((i,))
        if gone:
            yield from self._changes(key, timerValues.getCurrentWatermarkInMs())
        elif self.shown.exists() and self.shown.get()[1] is None:
            self.shown.clear()

    def _changes(self, key, watermark: int) -> Iterator[pd.DataFrame]:
        best, tags = None, set()
        for (i,), (t, label, address, own) in self.items.iterator():
            tags.update(x for x in own.split(",") if x)
            if best is None or (-t, i) < (-best[3], best[1]):
                best = (label, i, address, t)
        version, *old = self.shown.get() if self.shown.exists() else (0, None, None, None, None, None)
        new = [*best, ",".join(sorted(tags))] if best else [None] * 5
        out = []
        if old != new:
            version += 1
            if old[0] is not None and old[0] != new[0]:
                out.append((key[0], version, *old, False))
            if best:
                out.append((key[0], version, *new, True))
            self.shown.update((version, *new))
            if not best:
                self.handle.registerTimer(watermark + self.REMEMBERED)
        if out:
            yield pd.DataFrame(out, columns=["title_key", "version", "label", "id", "key", "t", "tags", "live"])

    def close(self) -> None:
        pass


SHOWN = "label string, part int, title_key string, id long, key string, t long, tags string, version long, shown boolean"


class Label(StatefulProcessor):
    """The newest ``most`` stories of a part of a label: each that enters or leaves comes out, with a rising version.

    A label that holds many stories lies in several parts; the newest of the label are among those of its parts.
    """

    def __init__(self, most: int) -> None:
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.stories = handle.getMapState("stories", "title_key string", "version long, id long, key string, t long, tags string, shown boolean")
        self.version = handle.getValueState("version", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        version = self.version.get()[0] + 1 if self.version.exists() else 1
        out = []
        fresh = pd.concat(list(rows)).sort_values(["title_key", "version"]).drop_duplicates("title_key", keep="last")
        for title, story, i, address, t, tags, live in zip(*(fresh[c].tolist() for c in ("title_key", "version", "id", "key", "t", "tags", "live")), strict=True):
            old = self.stories.getValue((title,)) if self.stories.containsKey((title,)) else None
            if old and old[0] > story:
                continue
            if old and old[5]:
                out.append((title, *old[1:5], False))
            if live:
                self.stories.updateValue((title,), (story, i, address, t, tags, False))
            elif old:
                self.stories.removeKey((title,))
        ranked = sorted(((-v[3], v[1], title, v) for (title,), v in self.stories.iterator()), key=lambda x: x[:3])
        for at, (_, _, title, v) in enumerate(ranked):
            if (at < self.most) != v[5]:
                self.stories.updateValue((title,), (*v[:5], at < self.most))
                out.append((title, *v[1:5], at < self.most))
        self.version.update((version,))
        # of a title that leaves and enters again in one batch, only where it ends is told
        ended = {row[0]: row for row in out}
        if ended:
            yield pd.DataFrame([(*key, *row[:5], version, row[5]) for row in ended.values()], columns=["label", "part", "title_key", "id", "key", "t", "tags", "version", "shown"])

    def close(self) -> None:
        pass
