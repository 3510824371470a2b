"""The stream-shaped operators: job status and sentence segments as events arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cuegrid.functions.text import SENTENCE_END
from cuegrid.settings import Settings


def latest_jobs_stream(log: DataFrame) -> DataFrame:
    """job_id, status, ts from a stream of (job_id, status, ts, event_id); run it in update mode. The
    state is one row a job, whatever its history."""
    newest = F.max(F.struct("ts", "event_id", "status")).alias("n")
    return log.groupBy("job_id").agg(newest).select("job_id", "n.status", "n.ts")


_SEGMENT = "video_id long, index int, start double, end double, text string"
_STATE = "words string, index int"


def sentence_segments_stream(words: DataFrame, settings: Settings = Settings(), idle: str = "10 minutes") -> DataFrame:
    """Sentence segments from a stream of (video_id, pos, start, end, word, ts), each as soon as it is
    known to be complete: a pause shows only with the next word, and the last segment of a video comes
    out when no word has arrived for ``idle``. Words of a video are taken in the order of pos within a
    trigger. Same rules as the batch operator."""
    import json
    import re

    ends = re.compile(SENTENCE_END)
    timeout_ms = int(pd.Timedelta(idle).total_seconds() * 1000)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept, index = ([], 0) if not state.exists else (json.loads(state.get[0]), state.get[1])
        out = []

        def flush():
            nonlocal kept, index
            text = "".join(w[2] for w in kept).strip()
            if text:
                out.append((key[0], index, kept[0][0], kept[-1][1], text))
                index += 1
            kept = []

        if state.hasTimedOut:
            if kept:
                flush()
            state.remove()
        else:
            rows = pd.concat(list(batches)).sort_values("pos")
            for start, end, word in zip(rows["start"], rows["end"], rows["word"], strict=True):
                if kept and start - kept[-1][1] > settings.max_gap:
                    flush()
                kept.append((float(start), float(end), word))
                length = len("".join(w[2] for w in kept).strip())
                if ends.search(word) or length >= settings.max_chars or kept[-1][1] - kept[0][0] >= settings.max_duration:
                    flush()
            state.update((json.dumps(kept), index))
            state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame(out, columns=["video_id", "index", "start", "end", "text"])

    return words.groupBy("video_id").applyInPandasWithState(run, _SEGMENT, _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
