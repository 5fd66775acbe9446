"""Table shapes and status constants of the transcript operators."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

# Statuses of an item, in the order of its life.
NEW, DOWNLOADING, DOWNLOADED, TRANSCRIBING, TRANSCRIPT_READY = "new", "downloading", "downloaded", "transcribing", "transcript_ready"
CORRECTING, CORRECTED, SUMMARIZING, SUMMARIZED, SUMMARY_READY = "correcting", "corrected", "summarizing", "summarized", "summary_ready"
SUCCESS, UPLOADED, ERROR, SKIPPED_AI, SKIPPED_OLD = "success", "uploaded", "error", "skipped_ai", "skipped_old"
QUEUEABLE = [NEW, ERROR, DOWNLOADING, TRANSCRIBING, TRANSCRIPT_READY, CORRECTING, CORRECTED, SUMMARIZING, SUMMARIZED, SUCCESS]
TERMINAL = [UPLOADED, SUCCESS, SKIPPED_OLD, SKIPPED_AI]
PUBLISHABLE = [SUMMARIZED, CORRECTED, TRANSCRIPT_READY, SUMMARY_READY]
STAGE_STATUSES = {
    "download": [NEW, DOWNLOADING],
    "transcribe": [DOWNLOADED, TRANSCRIBING],
    "llm": [TRANSCRIPT_READY, CORRECTING, CORRECTED, SUMMARIZING],
    "publish": PUBLISHABLE,
    "upload": [SUCCESS],
}
RECOVERY = {TRANSCRIBING: DOWNLOADED, CORRECTING: TRANSCRIPT_READY, SUMMARIZING: CORRECTED}
ALLOWED_EDGES = [
    (NEW, DOWNLOADING), (NEW, SKIPPED_AI), (NEW, SKIPPED_OLD), (DOWNLOADING, DOWNLOADED), (DOWNLOADED, TRANSCRIBING), (TRANSCRIBING, TRANSCRIPT_READY),
    (TRANSCRIPT_READY, CORRECTING), (CORRECTING, CORRECTED), (CORRECTED, SUMMARIZING), (SUMMARIZING, SUMMARIZED), (SUMMARIZED, SUCCESS), (SUCCESS, UPLOADED),
    (DOWNLOADING, ERROR), (TRANSCRIBING, ERROR), (CORRECTING, ERROR), (SUMMARIZING, ERROR),
]

_S, _I, _L, _D = StringType(), IntegerType(), LongType(), DoubleType()


def _struct(**fields) -> StructType:  # noqa: ANN003
    return StructType([StructField(k, v) for k, v in fields.items()])


CATALOG = _struct(item_id=_S, title=_S, url=_S, duration_s=_I, author=_S, aid=_L, cid=_L, pubdate=_L)
API_ITEM = _struct(bvid=_S, title=_S, duration=_I, owner=_struct(name=_S), aid=_L, cid=_L, pubdate=_L)
API_ENVELOPE = _struct(code=_I, message=_S, data=_struct(list=ArrayType(API_ITEM)))
QUEUE_ITEM = _struct(bvid=_S, title=_S, url=_S, duration=_I, up_name=_S, pubdate=_L)
QUEUE_ENVELOPE = _struct(generated_at=_S, queue=ArrayType(QUEUE_ITEM))
STATE_FIELDS = ["status", "first_seen", "last_seen", "first_attempt", "last_attempt", "pubdate", "audio_path", "transcript_md", "corrected_md", "summary_md", "epub_path", "title", "up_name", "language", "error"]
STATE = StructType([StructField("item_id", _S, False), *[StructField(f, _L if f == "pubdate" else _S) for f in STATE_FIELDS]])
STATE_ENTRY = StructType(STATE.fields[1:])
TURNS = _struct(item_id=_S, seq=_I, speaker=_S, start_s=_D, end_s=_D, text=_S)
