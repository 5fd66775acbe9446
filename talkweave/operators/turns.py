"""Speaker turns: merging, batching, attribution, relabelling, packing, rendering (D7, F)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from talkweave.functions import text as X

# Limits of the speech stage, in seconds, characters and turns.
MERGE_GAP, MERGE_SPAN = 3.0, 120.0
BATCH_TURNS, BATCH_SECONDS = 8, 240.0
CHUNK_SECONDS, CHUNK_SLACK, PROBE_SECONDS = 180, 30, 120.0
SIGNIFICANT_SHARE, SIGNIFICANT_CHARS = 0.05, 100
PARAGRAPH, CHUNK_CHARS = 500, 2500


def split_sentences(text: Column) -> Column:
    """Pieces that end with sentence marks, stripped, without empty ones; the unterminated tail is the last."""
    return F.filter(F.transform(F.split(text, "(?<=[。！？；.!?;])"), X.ustrip), lambda s: s != "")


def first_beyond(values: np.ndarray, base: np.ndarray, limit: float) -> np.ndarray:
    """For every place i the first j > i with values[j] - base[i] > limit, or the number of places.

    Maxima over ranges of powers of two are made once; all places then descend through them together.
    """
    n = len(values)
    maxima = [values]
    while 2 << (len(maxima) - 1) <= n:
        step = 1 << (len(maxima) - 1)
        maxima.append(np.maximum(maxima[-1][:-step], maxima[-1][step:]))
    j = np.arange(1, n + 1)
    for k in range(len(maxima) - 1, -1, -1):
        fits = np.flatnonzero(j + (1 << k) <= n)
        passed = fits[maxima[k][j[fits]] - base[fits] <= limit]
        j[passed] += 1 << k
    return j


def reached(successor: np.ndarray) -> np.ndarray:
    """The places on the way from place 0, by pointer doubling; a successor of the array's length ends it."""
    n = len(successor)
    jump, on = np.append(successor, n), np.zeros(n + 1, bool)
    on[0] = True
    while True:
        places = np.flatnonzero(on)
        further = jump[places]
        if (further == n).all():
            return places[places < n]
        on[further] = True
        jump = jump[jump]


def _packed(own: np.ndarray, first: np.ndarray, closing: np.ndarray, fresh: np.ndarray, limit: int) -> np.ndarray:
    """The items that open groups; ``fresh`` ones do in any case. A group begins with the ``first`` size of the item that opens it (a fresh one's ``own``), and adds the ``own`` ones of the others; items that aren't ``closing`` open none."""
    total = np.cumsum(own)
    values = np.where(closing, total - own + first, np.iinfo(np.int64).min // 4)
    values[fresh] = np.iinfo(np.int64).max // 4
    return reached(first_beyond(values, total - np.where(fresh, own, first), limit))


#: Items that are packed together.
PACKED = 1 << 16
#: Of items: sizes in a group, as its first item, and whether they close the group before.
Sizes = Callable[[pa.Array], tuple[np.ndarray, np.ndarray, np.ndarray]]


def _joined(lists: pa.Array, sizes: Sizes, limit: int, separator: str) -> pa.Array:
    """Each list's items joined in groups."""
    counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
    items = lists.flatten()
    own, first, closing = sizes(items)
    ends = np.cumsum(counts)
    opens, low, row = [np.zeros(0, np.int64)], 0, 0
    while row < len(counts):
        stop = max(row + 1, int(np.searchsorted(ends, low + PACKED, "right")))
        high = int(ends[stop - 1])
        fresh = np.zeros(high - low, bool)
        fresh[(ends - counts - low)[row:stop][counts[row:stop] > 0]] = True
        if high > low:
            opens.append(_packed(own[low:high], first[low:high], closing[low:high], fresh, limit) + low)
        low, row = high, stop
    at = np.concatenate(opens)
    groups = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(at, len(items)), pa.int32()), items), separator)
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(at, np.concatenate([[0], ends])), pa.int32()), groups)


def greedy_groups(items: Column, sizes: Sizes, limit: int, separator: str) -> Column:
    """Consecutive items joined in groups: a group closes when it isn't empty and its size and the next one's exceed ``limit``.

    Where each group would end is searched for all items of an Arrow batch at once, and pointer doubling finds the groups that
    there are, so that the cost is in proportion to the items, however many groups a text has.
    """

    @F.arrow_udf("array<string>")
    def grouped(lists: pa.Array) -> pa.Array:
        return _joined(lists, sizes, limit, separator)

    return grouped(items)


def pack_paragraphs(text: Column, target: int = PARAGRAPH, check_tail: bool = True) -> Column:
    """Sentences packed to paragraphs of ``target`` characters; check_tail=False appends the unterminated tail unchecked."""

    def sizes(items: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = pc.utf8_length(items).to_numpy().astype(np.int64)
        return n, n, np.ones(len(n), bool) if check_tail else pc.match_substring_regex(items, "[。！？；.!?;]$").to_numpy(zero_copy_only=False)

    packed = greedy_groups(split_sentences(text), sizes, target, "")
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.array().cast("array<string>")).when(F.size(packed) == 0, F.array(text)).otherwise(packed)


def pack_chunks(text: Column, limit: int = CHUNK_CHARS) -> Column:
    """Non-blank lines packed to chunks; a line adds two for its separator, except the one that opens a later chunk."""

    def sizes(items: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = pc.utf8_length(items).to_numpy().astype(np.int64)
        return n + 2, n, np.ones(len(n), bool)

    packed = greedy_groups(F.filter(F.split(text, "\n"), lambda x: X.ustrip(x) != ""), sizes, limit, "\n\n")
    return F.when(text.isNull(), F.lit(None)).when(F.size(packed) == 0, F.array(text)).otherwise(packed)


#: Of some ordered rows: which open a group? Gets values, which rows are the first of their key, and what was carried from the rows before, if the first row goes on; returns it for the next rows too.
Opens = Callable[[list[pa.Array], np.ndarray, object], tuple[np.ndarray, object]]


def numbered_groups(rows: DataFrame, keys: list[str], order: str, values: list[str], opens: Opens, name: str) -> DataFrame:
    """The rows with ``name``: the number of the group that a greedy rule over the ordered rows of each key puts them in.

    Only keys, order and values leave the JVM, sorted within partitions, a batch at a time; between batches
    only the state of the open group is kept, however many rows a key has.  Nothing is done row by row.
    ``order`` is unique within a key.
    """
    names = [f"_k{i}" for i in range(len(keys) + 1)]
    narrow = rows.select(*[F.col(c).alias(n) for c, n in zip([*keys, order], names, strict=True)], *[F.col(v).alias(f"_v{i}") for i, v in enumerate(values)])
    schema = narrow.select(*names).withColumn(name, F.lit(0)).schema

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carried, group = None, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            fresh = np.zeros(batch.num_rows, bool)
            for c in names[:-1]:
                column = batch[c].dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                fresh[1:] |= column[1:] != column[:-1]
            fresh[0] = [batch[c][0].as_py() for c in names[:-1]] != last
            flags, carried = opens([batch[f"_v{i}"] for i in range(len(values))], fresh, None if fresh[0] else carried)
            count = np.cumsum(flags)
            starts = np.flatnonzero(fresh)
            base = np.full(batch.num_rows, -group, np.int64)
            base[starts[0] if len(starts) else batch.num_rows :] = np.repeat(count[starts], np.diff(np.append(starts, batch.num_rows)))
            numbers = count - base
            last, group = [batch[c][-1].as_py() for c in names[:-1]], int(numbers[-1])
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array(numbers.astype(np.int32))], [*names, name])

    numbered = narrow.repartition(*names[:-1]).sortWithinPartitions(*names).mapInArrow(number, schema)
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(n)) for c, n in zip([*keys, order], names, strict=True)])
    return rows.join(numbered, same).drop(*names)


def _by_size(limit: int) -> Opens:
    """A group closes when its size and the next row's exceed ``limit``; carried: the open group's size."""

    def opens(values: list[pa.Array], fresh: np.ndarray, carried: object) -> tuple[np.ndarray, object]:
        n = np.concatenate([[carried] if carried is not None else [], values[0].to_numpy()]).astype(np.int64)
        new = np.concatenate([[True] if carried is not None else [], fresh]).astype(bool)
        places = _packed(n, n, np.ones(len(n), bool), new, limit)
        flags = np.zeros(len(n), bool)
        flags[places] = True
        return flags[len(n) - len(fresh) :], int(n[places[-1] :].sum())

    return opens


def _by_speaker(gap: float, span: float) -> Opens:
    """A turn goes on while the speaker stays, the gap to the turn before is at most ``gap`` and all at most ``span`` long; carried: speaker, start and last end of the open turn."""

    def opens(values: list[pa.Array], fresh: np.ndarray, carried: object) -> tuple[np.ndarray, object]:
        known = carried is not None
        code = values[0].dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        start, end = (np.concatenate([[carried[i]] if known else [], v.to_numpy(zero_copy_only=False)]).astype(float) for i, v in ((1, values[1]), (2, values[2])))
        other = np.concatenate([[True] if known else [], [True], code[1:] != code[:-1]]).astype(bool)
        if known:
            other[1] = carried[0] != values[0][0].as_py()
        closes = other | np.concatenate([[True] if known else [], fresh]).astype(bool)
        closes[1:] |= ~(start[1:] - end[:-1] <= gap)
        limits = np.where(closes | np.isnan(end), np.inf, end)
        places = reached(first_beyond(limits, start, span))
        flags = np.zeros(len(start), bool)
        flags[places] = True
        return flags[known:], (values[0][-1].as_py(), float(start[places[-1]]), float(end[-1]))

    return opens


def _by_number(most: int, seconds: float) -> Opens:
    """A batch closes when it has ``most`` rows or the next one would pass ``seconds``; carried: number and length of the open one.

    Lengths are added in the order of rows, from each row on, so that sums are those of a fold.
    """

    def opens(values: list[pa.Array], fresh: np.ndarray, carried: object) -> tuple[np.ndarray, object]:
        known = carried is not None
        length = np.concatenate([[carried[1]] if known else [], values[1].to_numpy(zero_copy_only=False) - values[0].to_numpy(zero_copy_only=False)]).astype(float)
        new = np.concatenate([[True] if known else [], fresh]).astype(bool)
        n = len(length)
        count, total, successor = np.ones(n, np.int64), length.copy(), np.full(n, n)
        count[0] = carried[0] if known else 1
        alive, step = np.arange(n - 1), 1
        while len(alive):
            after = alive + step
            ends = new[after] | (count[alive] >= most) | (total[alive] + length[after] > seconds)
            successor[alive[ends]] = after[ends]
            alive, after = alive[~ends], after[~ends]
            count[alive] += 1
            total[alive] += length[after]
            step += 1
            alive = alive[alive + step < n]
        places = reached(successor)
        flags = np.zeros(n, bool)
        flags[places] = True
        return flags[known:], (int(count[places[-1]]), float(total[places[-1]]))

    return opens


def ordered(at: str, value: str) -> Column:
    """The values of a group in order, as an array."""
    return F.transform(F.sort_array(F.collect_list(F.struct(at, value))), lambda s: s[value])


def pack_segments(segments: DataFrame, keys: list[str], order: str = "seq", target: int = PARAGRAPH) -> DataFrame:
    """Segments' texts packed by the same rule: keys, paragraph_no, text."""

    rows = segments.select(*keys, order, X.ustrip(F.coalesce("text", F.lit(""))).alias("text")).where("text <> ''").withColumn("_n", F.length("text"))
    return numbered_groups(rows, keys, order, ["_n"], _by_size(target), "paragraph_no").groupBy(*keys, "paragraph_no").agg(F.array_join(ordered(order, "text"), "").alias("text"))


def merge_turns(turns: DataFrame, gap: float = MERGE_GAP, span: float = MERGE_SPAN) -> DataFrame:
    """Turns of one speaker merged while the gap is at most ``gap`` and the merged turn at most ``span`` long."""

    rows = turns.select("item_id", F.col("seq").cast("int").alias("seq"), "speaker", "start_s", "end_s", "text")
    grouped = numbered_groups(rows, ["item_id"], "seq", ["speaker", "start_s", "end_s"], _by_speaker(gap, span), "_turn").groupBy("item_id", "_turn")
    merged = grouped.agg(
        F.min("seq").alias("seq"), F.min_by("speaker", "seq").alias("speaker"), F.min_by("start_s", "seq").alias("start_s"), F.max_by("end_s", "seq").alias("end_s"),
        F.array_join(ordered("seq", "text"), " ").alias("text"), F.count("*").cast("int").alias("n_turns"),
    )
    return merged.drop("_turn")


def batch_turns(turns: DataFrame, most: int = BATCH_TURNS, seconds: float = BATCH_SECONDS) -> DataFrame:
    """Turns with batch_no: a batch closes when it has ``most`` turns or the next one would pass ``seconds``."""

    return numbered_groups(turns, ["item_id"], "seq", ["start_s", "end_s"], _by_number(most, seconds), "batch_no")


def plan_chunks(items: DataFrame, seconds: int = CHUNK_SECONDS, slack: int = CHUNK_SLACK) -> DataFrame:
    """(item_id, chunk_no, start_s, end_s): one chunk up to seconds + slack, else chunks of ``seconds``, the last one shorter."""
    d = F.col("duration_s")
    count = F.when(d <= seconds + slack, 1).otherwise(F.ceil(d / seconds)).cast("int")
    rows = items.where(d.isNotNull()).select("item_id", d, F.posexplode(F.sequence(F.lit(0), count - 1)).alias("chunk_no", "_"), count.alias("_n"))
    return rows.select("item_id", "chunk_no", (F.col("chunk_no") * seconds).alias("start_s"), F.when(F.col("_n") == 1, d).otherwise(F.least((F.col("chunk_no") + 1) * seconds, d)).alias("end_s"))


def speaker_probe(turns: DataFrame, durations: DataFrame, seconds: float = PROBE_SECONDS) -> DataFrame:
    """(item_id, n_speakers, probe_is_full, single_route) from the turns that start in the first ``seconds``."""
    early = turns.where(F.col("start_s") < seconds).groupBy("item_id").agg(F.count_distinct("speaker").alias("n"))
    rows = durations.join(early, "item_id", "left").withColumn("n_speakers", F.coalesce("n", F.lit(0)))
    return rows.select("item_id", "n_speakers", (F.col("duration_s") <= seconds).alias("probe_is_full"), (F.col("n_speakers") <= 1).alias("single_route"))


def diarized_turns(turns: DataFrame, durations: DataFrame, seconds: float = PROBE_SECONDS) -> DataFrame:
    """The turns of items whose probe found several speakers, with ``reused``: the probe covered the item, so its turns are final.

    The items to keep come from the turns of the first ``seconds`` and carry an id and a flag only.  While they
    are few, adaptive execution broadcasts them; beyond, they are the side from which Spark makes its own
    filter at run time, so turns of single-speaker items are dropped before the shuffle of the join.
    """
    wanted = speaker_probe(turns, durations, seconds).where("NOT single_route").select("item_id", F.col("probe_is_full").alias("reused"))
    return turns.join(wanted, "item_id")


def speaker_stats(turns: DataFrame) -> DataFrame:
    """(item_id, speaker, chars, first_seq, share) over non-empty turns."""
    n = F.length(X.ustrip(F.coalesce("text", F.lit(""))))
    stats = turns.where(n > 0).groupBy("item_id", "speaker").agg(F.sum(n).alias("chars"), F.min("seq").alias("first_seq"))
    return stats.withColumn("share", F.col("chars") / F.sum("chars").over(Window.partitionBy("item_id")))


def significant_speakers(stats: DataFrame, share: float = SIGNIFICANT_SHARE, chars: int = SIGNIFICANT_CHARS) -> DataFrame:
    """Stats with ``prominent`` (most characters, first seen on ties) and ``significant``; without any significant one, the prominent."""
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("chars"), "first_seq"))
    own = (F.col("share") > share) | (F.col("chars") > chars)
    rows = stats.withColumns({"prominent": rank == 1, "_own": own})
    some = F.max("_own").over(Window.partitionBy("item_id"))
    return rows.withColumn("significant", F.when(some, F.col("_own")).otherwise(F.col("prominent"))).drop("_own")


def relabel_insignificant(turns: DataFrame, speakers: DataFrame, skip_empty: bool = False) -> DataFrame:
    """Turns with ``effective``: the speaker if significant, else the last significant one before, else the prominent one."""
    if skip_empty:
        turns = turns.where(F.length(X.ustrip(F.coalesce("text", F.lit("")))) > 0)
    marks = speakers.select("item_id", "speaker", "significant")
    best = speakers.where("prominent").select("item_id", F.col("speaker").alias("_best"))
    rows = turns.join(marks, ["item_id", "speaker"], "left").join(best, "item_id", "left")
    before = F.last(F.when(F.col("significant"), F.col("speaker")), ignorenulls=True).over(Window.partitionBy("item_id").orderBy("seq"))
    return rows.withColumn("effective", F.coalesce(before, F.col("_best"))).drop("_best", "significant")


def speaker_blocks(turns: DataFrame, speaker: str = "effective") -> DataFrame:
    """(item_id, block, speaker, text): runs of one speaker."""
    w = Window.partitionBy("item_id").orderBy("seq")
    new = ~F.coalesce(F.lag(speaker).over(w).eqNullSafe(F.col(speaker)) & F.lag("seq").over(w).isNotNull(), F.lit(False))
    rows = turns.withColumn("block", F.sum(new.cast("int")).over(w))
    rows = rows.withColumn("text", X.ustrip(F.coalesce("text", F.lit(""))))
    return rows.groupBy("item_id", "block", F.col(speaker).alias("speaker")).agg(F.array_join(ordered("seq", "text"), "").alias("text"))


def speaker_labels(speakers: DataFrame) -> DataFrame:
    """(item_id, speaker, label) by rank among the item's sorted speakers."""
    rank = F.dense_rank().over(Window.partitionBy("item_id").orderBy("speaker")) - 1
    return speakers.select("item_id", "speaker").distinct().withColumn("label", X.rank_label(rank))


def with_names(turns: DataFrame, names: DataFrame) -> DataFrame:
    """Turns with the speaker's name from (item_id, names map), or the raw label."""
    return turns.join(names, "item_id", "left").withColumn("name", F.coalesce(F.col("names")[F.col("speaker")], F.col("speaker"))).drop("names")


def assign_speakers(segments: DataFrame, diarization: DataFrame, bucket: float = 60.0) -> DataFrame:
    """Segments with the speaker of the greatest total overlap (by name on ties), null without overlap.

    Both sides are dealt into time buckets, so the overlap join is an equality join; each
    overlap is counted in the bucket where it begins.
    """
    place = lambda c: F.floor(c / bucket)
    # the last bucket may begin exactly at the end; it then holds nothing
    spread = lambda a, b: F.explode(F.sequence(place(F.col(a)), F.greatest(place(F.col(a)), place(F.col(b)))))
    left = segments.select("item_id", "seq", "start_s", "end_s", spread("start_s", "end_s").alias("_b"))
    right = diarization.select("item_id", F.col("speaker").alias("_speaker"), F.col("start_s").alias("_s"), F.col("end_s").alias("_e"), spread("start_s", "end_s").alias("_b"))
    begin, end = F.greatest("start_s", "_s"), F.least("end_s", "_e")
    both = left.join(right, ["item_id", "_b"]).where((end > begin) & (place(begin) == F.col("_b")))
    total = both.groupBy("item_id", "seq", "_speaker").agg(F.sum(end - begin).alias("_overlap"))
    best = total.groupBy("item_id", "seq").agg(F.min(F.struct((-F.col("_overlap")).alias("o"), F.col("_speaker").alias("s"))).alias("best"))
    return segments.drop("speaker").join(best, ["item_id", "seq"], "left").withColumn("speaker", F.col("best.s")).drop("best")


def render_transcript(items: DataFrame, turns: DataFrame, style: str = "qwen") -> DataFrame:
    """(item_id, md): header and paragraphs; with several significant speakers each paragraph has its label. items: item_id, title, author."""
    speakers = significant_speakers(speaker_stats(turns))
    several = speakers.where("significant").groupBy("item_id").agg((F.count("*") > 1).alias("several"))
    labels = speaker_labels(speakers)
    blocks = speaker_blocks(relabel_insignificant(turns, speakers, style == "whisperx")).join(labels, ["item_id", "speaker"], "left").join(several, "item_id", "left")
    label = X.id_label(F.col("speaker")) if style == "whisperx" else F.col("label")
    prefix = F.when(F.col("several"), F.concat(F.lit("**"), label, F.lit("** "))).otherwise("")
    paragraphs = F.transform(pack_paragraphs(F.col("text"), check_tail=style != "qwen"), lambda p: F.concat(prefix, p))
    body = blocks.select("item_id", "block", paragraphs.alias("p")).groupBy("item_id").agg(F.array_join(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("block", "p"))), lambda s: s["p"])), "\n\n").alias("body"))
    author = F.when(F.coalesce("author", F.lit("")) != "", F.concat(F.lit(f"\n\n**{X.AUTHOR_LABEL}**: "), F.col("author"))).otherwise("")
    head = F.concat(F.lit("# "), F.col("title"), F.lit("")) if style == "whisperx" else F.concat(F.lit("# "), F.col("title"), author, F.lit("\n\n---"))
    return items.join(body, "item_id", "left").select("item_id", F.concat(head, F.lit("\n\n"), F.coalesce(X.filled(F.col("body")), F.lit(X.NO_TRANSCRIPT)), F.lit("\n")).alias("md"))


def render_plain(items: DataFrame, segments: DataFrame) -> DataFrame:
    """(item_id, md): header and packed paragraphs of segments without speakers; an item without any says that it failed.

    items: item_id, title, author; segments: item_id, seq, text.
    """
    packed = pack_segments(segments, ["item_id"])
    body = packed.groupBy("item_id").agg(F.array_join(ordered("paragraph_no", "text"), "\n\n").alias("body"))
    author = F.concat(F.lit(f"**{X.AUTHOR_LABEL}**: "), F.coalesce("author", F.lit("")), F.lit("\n\n"))
    rows = items.join(body, "item_id", "left")
    named = F.when(F.col("body").isNull() | X.filled(F.col("author")).isNotNull(), author).otherwise("")
    end = F.coalesce(F.concat("body", F.lit("\n")), F.lit(X.NO_TRANSCRIPT))
    return rows.select("item_id", F.concat(F.lit("# "), F.col("title"), F.lit("\n\n"), named, F.lit("---\n\n"), end).alias("md"))


def timestamped_lines(segments: DataFrame, decimal: bool = False) -> DataFrame:
    """(item_id, text): the stamped lines of each item in order. segments: item_id, seq, start_s, end_s, text."""
    line = X.timestamped_line(F.col("start_s"), F.col("end_s"), F.col("text"), decimal)
    return segments.select("item_id", "seq", line.alias("line")).groupBy("item_id").agg(F.array_join(ordered("seq", "line"), "\n").alias("text"))
