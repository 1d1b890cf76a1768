"""Lines out of chunks of bytes, as a stateful operator.

What a tool writes comes in chunks (source, seq, data, last) that are cut anywhere, also inside a character. Each source has its
own state: the next chunk's number, the pieces of the line that is not ended, chunks that came too early, and whether the source is
spoiled. Lines end in \\n or \\r, empty ones are left out, and the chunk marked as the last ends a line as well. The first line that
`spoils` has an answer for is given with that answer as its error, and nothing of its source follows; so is a source whose open
line passes `most_bytes`, or which has more than `most_early` chunks waiting, as state must stay bounded.

Chunks of a number that was seen are repeats and are dropped. Bytes that are no UTF-8 are replaced. A chunk without a number or
with null data is dropped too.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_CUT = re.compile(rb"[\r\n]")
#: The state store that operators of this kind need.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class LineAssembler(StatefulProcessor):
    """State and step of one source; see the module."""

    def __init__(self, key: str, spoils: Callable[[str], str | None], most_bytes: int, most_early: int):
        self.names = (key, "n", "line", "error")
        self.spoils, self.most_bytes, self.most_early = spoils, most_bytes, most_early

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.place = handle.getValueState("place", "seq long, lines long, open long, early int, done boolean")
        self.pieces = handle.getListState("pieces", "data binary")
        self.early = handle.getMapState("early", "seq long", "data binary, last boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        seq, lines, size, early, done = self.place.get() or (0, 0, 0, 0, False)
        open_ = bytearray()  # what this batch adds to the open line; what batches before have is in `pieces`
        stored, out = size > 0, []

        def end(line: bytes) -> str | None:
            """Gives a line out; what spoils the source, if it does."""
            nonlocal lines
            if not line:
                return None
            text = line.decode("utf-8", "replace")
            lines += 1
            error = self.spoils(text)
            out.append((*key, lines, text, error))
            return error

        def whole() -> bytes:
            nonlocal stored, size
            before = b"".join(bytes(p[0]) for p in self.pieces.get()) if stored else b""
            if stored:
                self.pieces.clear()
            line = before + bytes(open_)
            open_.clear()
            stored, size = False, 0
            return line

        def take(data: bytes, last: bool) -> bool:
            """One chunk in its turn; whether the source is done with."""
            nonlocal size
            parts = _CUT.split(data)
            for k, part in enumerate(parts):
                open_.extend(part)
                size += len(part)
                if size > self.most_bytes:
                    out.append((*key, lines + 1, None, f"a line of more than {self.most_bytes} bytes"))
                    return True
                if (k + 1 < len(parts) or last) and end(whole()) is not None:
                    return True
            return last

        for _, n, data, last in rows:
            if done or n < seq:
                continue
            if n > seq:
                if not self.early.containsKey((n,)):
                    early += 1
                    self.early.updateValue((n,), (bytes(data), last))
                if early > self.most_early:
                    out.append((*key, lines + 1, None, f"more than {self.most_early} chunks wait for one that is missing"))
                    done = True
                continue
            done, seq = take(bytes(data), last), seq + 1
            while early and not done and self.early.containsKey((seq,)):
                data, last = self.early.getValue((seq,))
                self.early.removeKey((seq,))
                done, seq, early = take(bytes(data), last), seq + 1, early - 1
        if done:
            if stored:
                self.pieces.clear()
            if early:
                self.early.clear()
            size = early = 0
        elif open_:
            self.pieces.appendValue((bytes(open_),))
        self.place.update((seq, lines, size, early, done))
        named = Row(*self.names)
        for found in out:
            yield named(*found)

    def close(self) -> None:
        pass


def assembled(chunks: DataFrame, key: str, spoils: Callable[[str], str | None] | None = None, most_bytes: int = 1 << 20, most_early: int = 1024) -> DataFrame:
    """(key, n, line, error) of the chunks (key, seq from 0, data, last), a stream or a table. `spoils` is called on the
    executors with each line: a text is what is wrong with it."""
    spark = chunks.sparkSession
    if spark.conf.get(STORE[0], None) != STORE[1]:
        spark.conf.set(*STORE)
    _ = spark.streams.active  # the manager of streams starts the coordinator of state stores, which a table needs as well
    some = chunks.select(key, F.col("seq").cast("long").alias("seq"), F.col("data").cast("binary").alias("data"), F.coalesce("last", F.lit(False)).alias("last")).where("seq is not null and data is not null")
    step = LineAssembler(key, spoils or (lambda line: None), most_bytes, most_early)
    return some.groupBy(key).transformWithState(step, f"{key} {dict(some.dtypes)[key]}, n long, line string, error string", "Append", "None")


def unexpected(line: str) -> str | None:
    """What spoils a source of diagnostics: a line of no known form (`functions.diagnostics.line_form`)."""
    from ..functions.diagnostics import known_form

    return None if known_form(line) else f"unexpected output: {line}"
