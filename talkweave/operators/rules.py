"""Rule filters, selections and projections of catalog and state rows (B)."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkweave import schemas as S
from talkweave.functions import lookup
from talkweave.functions import text as X


@dataclass(frozen=True)
class Rules:
    min_seconds: int = 0
    author_deny: list[str] = field(default_factory=list)
    title_deny: list[str] = field(default_factory=list)
    keep_when_uncertain: bool = True


def too_short(rules: Rules) -> Column:
    return F.lit(False) if not rules.min_seconds else F.coalesce(F.col("duration_s") < rules.min_seconds, F.lit(False))


def author_denied(rules: Rules) -> Column:
    deny = [d.lower() for d in rules.author_deny if d.strip()]
    return reduce(lambda a, d: a | F.lower(F.coalesce("author", F.lit(""))).contains(d), deny, F.lit(False))


def author_denied_by(catalog: DataFrame, deny: DataFrame) -> DataFrame:
    """The rows with ``denied_by``: the first entry (by pos) of a deny table that the author's name contains, or null. deny: entry, pos."""
    return lookup.denied_by(catalog, "author", deny)


def title_denied(rules: Rules) -> Column:
    title = F.coalesce("title", F.lit(""))
    return (title != "") & reduce(lambda a, p: a | title.rlike("(?iu)" + p), X.valid_patterns(rules.title_deny), F.lit(False))


def fields_missing() -> Column:
    return (F.coalesce("item_id", F.lit("")) == "") | (F.coalesce("url", F.lit("")) == "")


def drop_reason(catalog: DataFrame, rules: Rules) -> DataFrame:
    """The rows with the first rule that drops them, or null."""
    missing = fields_missing() & F.lit(not rules.keep_when_uncertain)
    reason = F.when(too_short(rules), "too_short").when(author_denied(rules), "author").when(title_denied(rules), "title").when(missing, "missing_fields")
    return catalog.withColumn("drop_reason", reason)


def rule_filter(catalog: DataFrame, rules: Rules) -> DataFrame:
    return drop_reason(catalog, rules).where("drop_reason IS NULL").drop("drop_reason")


def ai_decision_filter(queue: DataFrame, state: DataFrame, responses: DataFrame, most: int) -> DataFrame:
    """The first ``most`` queue rows with status new, and whether the model's response skips them."""
    fresh = lookup_new(queue, state).orderBy("pos").limit(most)
    skip = F.coalesce(F.upper(X.ustrip(F.col("response"))).contains("SKIP"), F.lit(False))
    return fresh.join(responses.select("item_id", "response"), "item_id", "left").withColumn("skip", skip)


def skipped_outcomes(decided: DataFrame, now: Column) -> DataFrame:
    """Outcomes for ``outcome_updates`` of decided rows: those that are skipped keep title and author, and when they were tried; the others change nothing.

    decided: pos, item_id, title, author, skip.
    """
    extra = F.create_map(F.lit("title"), F.col("title"), F.lit("up_name"), F.col("author"), F.lit("last_attempt"), now.cast("string"))
    return decided.where("skip").select("item_id", F.col("pos").alias("seq"), F.lit("filter").alias("stage"), F.lit("skipped").alias("outcome"), F.lit(None).cast("string").alias("detail"), extra.alias("extra"), F.lit(S.NEW).alias("status"))


def lookup_new(queue: DataFrame, state: DataFrame) -> DataFrame:
    status = state.select("item_id", "status")
    return queue.join(status, "item_id", "left").where(F.coalesce("status", F.lit(S.NEW)) == S.NEW).drop("status")


def pending_items(state: DataFrame, status: str) -> DataFrame:
    return state.where(F.col("status") == status)


def with_summaries(state: DataFrame) -> DataFrame:
    return state.where(X.filled(F.col("summary_md")).isNotNull())


def with_transcripts(state: DataFrame) -> DataFrame:
    return state.where(X.filled(F.col("transcript_md")).isNotNull() | X.filled(F.col("summary_md")).isNotNull())


def drop_empty_turns(turns: DataFrame) -> DataFrame:
    return turns.where(F.length(X.ustrip(F.coalesce("text", F.lit("")))) > 0)


def download_plan(queue: DataFrame) -> DataFrame:
    """(item_id, url, stem): where a download's file goes."""
    stem = X.safe_filename(F.concat("item_id", F.lit("_"), F.substring(F.coalesce("title", F.lit("")), 1, 50)))
    return queue.select("item_id", "url", stem.alias("stem"))


def publish_source(state: DataFrame) -> DataFrame:
    """State rows with the path of the text to publish; rows without one go."""
    source = F.coalesce(X.filled(F.col("summary_md")), X.filled(F.col("transcript_md")))
    return state.withColumn("source_path", source).where("source_path IS NOT NULL")


def catalog_to_queue(catalog: DataFrame) -> DataFrame:
    return catalog.select("pos", "item_id", "title", "url", "duration_s", "author", "pubdate")
