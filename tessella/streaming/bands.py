"""Row-band encoding of image rows that arrive as a stream.

Rows of an image come in order, in batches of any size.  Each band of rows is
coded as one row of tiles as soon as it is complete, so the state of an image is
at most one unfinished band.  The finished codestream is the header, the tile
parts in order and the end marker, and does not depend on how rows were batched.
"""

from __future__ import annotations

import pickle
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessella.sources import jpeg2000

SECTIONS = "image_id long, section int, content binary, error string"


class BandEncoder:
    """Codes rows of a fixed size image band by band; ``sections`` are numbered from 0, which is the header."""

    def __init__(self, width: int, height: int, band: int, bits: int = 8, levels: int = 2):
        self.width, self.height, self.band, self.bits, self.levels = width, height, band, bits, levels
        self.rows: list[list[int]] = []
        self.done = 0

    def header(self) -> bytes:
        empty = jpeg2000.encode([np.zeros((1, 1), int)], self.bits, levels=self.levels)
        _, parts, _ = jpeg2000.parse(empty)
        head = bytearray(empty[: parts[0].start - 14])
        # sizes of the image and of a tile in the size segment
        struct.pack_into(">IIIIII", head, 8, self.width, self.height, 0, 0, self.width, self.band)
        return bytes(head)

    def add(self, y: int, row: list[int]) -> Iterator[tuple[int, bytes]]:
        """(section, bytes) of what the row completes; rows must come in order."""
        if y != self.done + len(self.rows):
            raise ValueError(f"row {y} came where row {self.done + len(self.rows)} was due")
        if len(row) != self.width:
            raise ValueError(f"row {y} has {len(row)} samples instead of {self.width}")
        if y == 0:
            yield 0, self.header()
        self.rows.append(row)
        last = y + 1 == self.height
        if len(self.rows) == self.band or last:
            tile = self.done // self.band
            plane = np.array(self.rows, np.int64)
            # coded at its own place in the image, as the decoder will see it
            h = jpeg2000.Header(self.width, self.height, 0, 0, self.width, self.band, 0, 0, [self.bits], [False], [(1, 1)], "LRCP", 1, False, self.levels)
            h.steps = jpeg2000._steps(self.levels, self.bits, True, False, 1.0)
            whole = np.zeros((self.done + len(self.rows), self.width), np.int64)
            whole[self.done :] = plane
            body = jpeg2000._encode_tile(h, tile, [whole])
            self.done += len(self.rows)
            self.rows = []
            part = struct.pack(">HHHIBBH", jpeg2000.SOT, 10, tile, len(body) + 14, 0, 1, jpeg2000.SOD) + body
            yield tile + 1, part + (struct.pack(">H", jpeg2000.EOC) if last else b"")


def encode_rows(rows: DataFrame, width: int, height: int, band: int = 16) -> DataFrame:
    """Streaming or batch: (image_id, y, row) -> sections (image_id, section, content, error).

    A row out of order, or of another width, ends its image with an error section.
    Rows of a batch are put in order first.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        encoder = pickle.loads(state.get[0]) if state.exists else BandEncoder(width, height, band)
        out = []
        table = pd.concat(list(parts)).sort_values("y")
        try:
            if encoder is not None:
                for y, row in zip(table["y"], table["row"], strict=True):
                    out += [(key[0], s, b, None) for s, b in encoder.add(int(y), list(row))]
        except ValueError as e:
            out.append((key[0], -1, None, str(e)))
            encoder = None
        state.update((pickle.dumps(encoder),))
        yield pd.DataFrame(out, columns=["image_id", "section", "content", "error"])

    return rows.select("image_id", "y", "row").groupBy("image_id").applyInPandasWithState(step, SECTIONS, "encoder binary", "append", GroupStateTimeout.NoTimeout)


def assemble(sections: DataFrame) -> DataFrame:
    """Finished sections -> (image_id, content): concatenated in order."""
    parts = sections.filter("error is null").groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("section", "content"))).alias("p"))
    empty = F.lit(b"").cast("binary")
    return parts.select("image_id", F.aggregate("p", empty, lambda a, s: F.concat(a, s["content"])).alias("content"))
