"""A stream of a growing file of JSON lines: only whole lines, with rotation and truncation noticed."""

from __future__ import annotations

import json
import os

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader


class FollowReader(SimpleDataSourceStreamReader):
    """Reads from a byte offset to the last line feed; the offset carries the file's identity and a generation."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.most = int(options.get("maxbytesperbatch", 64 << 20))

    def _identity(self) -> tuple[int, int, int] | None:
        try:
            s = os.stat(self.path)
        except FileNotFoundError:
            return None
        return s.st_dev, s.st_ino, s.st_size

    def initialOffset(self) -> dict:
        return {"dev": 0, "ino": 0, "at": 0, "generation": 0}

    def _rows(self, begin: int, end: int | None):
        with open(self.path, "rb") as f:
            f.seek(begin)
            data = f.read(self.most if end is None else end - begin)
        whole = data.rfind(b"\n") + 1
        rows = []
        for line in data[:whole].split(b"\n"):
            text = line.decode(errors="replace").strip()
            if text:
                try:
                    json.loads(text)
                    rows.append((text, None))
                except ValueError as e:
                    rows.append((text, str(e)))
        return rows, begin + whole

    def read(self, start: dict):
        now = self._identity()
        if now is None:
            return iter([]), start
        dev, ino, size = now
        offset = dict(start)
        known = (start["dev"], start["ino"]) in ((0, 0), (dev, ino))
        if not known or size < start["at"]:
            offset |= {"at": 0, "generation": start["generation"] + 1}
        offset |= {"dev": dev, "ino": ino}
        rows, offset["at"] = self._rows(offset["at"], None)
        return iter(rows), offset

    def readBetweenOffsets(self, start: dict, end: dict):
        begin = start["at"] if start["generation"] == end["generation"] else 0
        return iter(self._rows(begin, end["at"])[0])


class FollowSource(DataSource):
    """``spark.readStream.format("follow_jsonl").option("path", ...)``: (value, _parse_error), bad lines are rows too."""

    @classmethod
    def name(cls) -> str:
        return "follow_jsonl"

    def schema(self) -> str:
        return "value string, _parse_error string"

    def simpleStreamReader(self, schema):
        return FollowReader(self.options)


def follow(spark, path: str):
    """The stream of a file that grows on the driver's machine, as with a log that is looked at."""
    spark.dataSource.register(FollowSource)
    return spark.readStream.format("follow_jsonl").option("path", path).load()
