"""A streaming source of text lines from a socket, for chat line protocols."""

from __future__ import annotations

import socket
import time

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader


class LineReader(SimpleDataSourceStreamReader):
    """Reads what has arrived since the last batch; it reconnects after ``retry`` seconds.  The protocol has no replay."""

    def __init__(self, options: dict[str, str]):
        self.host, self.port = options["host"], int(options["port"])
        self.hello = options.get("hello", "")
        self.retry = float(options.get("retry", "3"))
        self.wait = float(options.get("wait", "0.2"))
        self.link, self.rest, self.kept = None, b"", {}

    def initialOffset(self) -> dict:
        return {"line": 0}

    def _connect(self) -> bool:
        try:
            self.link = socket.create_connection((self.host, self.port), timeout=self.wait)
            self.link.settimeout(self.wait)
            if self.hello:
                self.link.sendall(self.hello.encode())
            return True
        except OSError:
            self.link = None
            time.sleep(min(self.retry, 1.0))
            return False

    def read(self, start: dict):
        rows: list[tuple[float, str]] = []
        if self.link is not None or self._connect():
            try:
                data = self.link.recv(1 << 20)
                if not data:
                    self.link = None
                whole, _, self.rest = (self.rest + data).rpartition(b"\n")
                for line in whole.split(b"\n") if whole else []:
                    text = line.rstrip(b"\r").decode("utf-8", "replace")
                    if text.startswith("PING"):
                        self.link.sendall(text.replace("PING", "PONG", 1).encode() + b"\r\n")
                    elif text:
                        rows.append((time.time(), text))
            except TimeoutError:
                pass
            except OSError:
                self.link = None
        end = {"line": start["line"] + len(rows)}
        self.kept[start["line"], end["line"]] = rows
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict):
        return iter(self.kept.get((start["line"], end["line"]), []))

    def commit(self, end: dict) -> None:
        self.kept = {k: v for k, v in self.kept.items() if k[1] > end["line"]}


class ChatLines(DataSource):
    """``spark.readStream.format("chat_lines")`` with options host, port, hello, retry."""

    @classmethod
    def name(cls) -> str:
        return "chat_lines"

    def schema(self) -> str:
        return "received double, value string"

    def simpleStreamReader(self, schema) -> LineReader:
        return LineReader(self.options)
