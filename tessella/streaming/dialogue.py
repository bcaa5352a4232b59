"""Dialogue over a stream of script commands: the batch operator's carry-forward, with the speaker kept as state.

Commands of a path arrive in order of seq, over any number of batches; those of one batch may come in any order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

LINES = "path string, seq int, speaker_param int, string_id int"


def stream_dialogue(commands: DataFrame, speakers: tuple[int, ...] = (0x1D, 0x22), line: int = 0x4B) -> DataFrame:
    """(path, seq, speaker_param, string_id) of the lines in a stream of commands (path, seq, opcode, args)."""

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        speaker = state.get[0] if state.exists else None
        rows, out = pd.concat(list(frames)).sort_values("seq"), []
        for seq, opcode, args in zip(rows["seq"], rows["opcode"], rows["args"]):
            args = [] if args is None else list(args)
            if opcode in speakers:
                speaker = int(args[0]) if args else None
            elif opcode == line and args:
                out.append((key[0], int(seq), speaker, int(args[0])))
        state.update((speaker,))
        made = pd.DataFrame(out, columns=["path", "seq", "speaker_param", "string_id"])
        yield made.astype({"seq": "int32", "string_id": "int32", "speaker_param": "Int32"})

    return commands.groupBy("path").applyInPandasWithState(step, LINES, "speaker int", "append", "NoTimeout")
