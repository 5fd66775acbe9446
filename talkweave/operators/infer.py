"""Model calls as batch operators: requests, a caller's function, acceptance and reassembly (D6, G)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkweave.functions import text as X
from talkweave.operators import publish, turns


def infer(requests: DataFrame, respond: Callable[[str], str], concurrency: int | None = None) -> DataFrame:
    """The requests with response and error from ``respond`` on each prompt; a failure is a row, not the end of the job.

    concurrency: number of partitions, and so of simultaneous callers.
    """
    if concurrency:
        requests = requests.repartition(concurrency)

    def call(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            responses, errors = [], []
            for prompt in frame["prompt"]:
                try:
                    responses.append(respond(prompt))
                    errors.append(None)
                except Exception as e:  # any failure of the caller's function is a result
                    responses.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield frame.assign(response=responses, error=errors)

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema.fields)
    return requests.mapInPandas(call, f"{columns}, response string, error string")


#: Answers by digest of the prompt; see ``infer_once``.
ANSWERS = "digest string, response string, error string"


def infer_once(requests: DataFrame, respond: Callable[[str], str], store: str, in_flight: int = 4, waves: int = 8, concurrency: int | None = None) -> DataFrame:
    """The requests with response and error, each distinct prompt asked once and answers kept in ``store``.

    store: a shared folder.  Only prompts without a stored response are asked, those that failed before again; they are dealt
    by digest into ``waves`` jobs, each of which adds its answers when it ends, so that a run
    that broke off goes on with the waves that are left.  A task has up to ``in_flight`` calls open, and
    keeps the order of its rows.
    """
    spark = requests.sparkSession
    spark.createDataFrame([], ANSWERS).write.mode("append").parquet(store)
    digest = F.sha2(F.col("prompt").cast("binary"), 256)
    wanted = requests.where("prompt IS NOT NULL").select(digest.alias("digest"), "prompt").dropDuplicates(["digest"])

    def one(prompt: str) -> tuple[str | None, str | None]:
        try:
            return respond(prompt), None
        except Exception as e:  # any failure of the caller's function is a result
            return None, f"{type(e).__name__}: {e}"

    def call(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(in_flight) as pool:
            for frame in frames:
                answers: list[tuple[str | None, str | None]] = []
                for k in range(0, len(frame), in_flight):
                    answers += pool.map(one, frame["prompt"].iloc[k : k + in_flight])
                yield pd.DataFrame({"digest": frame["digest"], "response": [a for a, _ in answers], "error": [e for _, e in answers]})

    for wave in range(waves):
        known = spark.read.schema(ANSWERS).parquet(store).where("response IS NOT NULL").select("digest")
        left = wanted.where(F.pmod(F.xxhash64("digest"), F.lit(waves)) == wave).join(known, "digest", "left_anti")
        left = left.repartition(concurrency) if concurrency else left
        left.mapInPandas(call, ANSWERS).write.mode("append").parquet(store)
    stored = spark.read.schema(ANSWERS).parquet(store)
    # a prompt that failed once and was answered later has several rows
    best = stored.groupBy(F.col("digest").alias("_digest")).agg(F.max("response").alias("response"), F.max("error").alias("error"))
    joined = requests.join(best.withColumn("error", F.when(F.col("response").isNull(), F.col("error"))), digest == F.col("_digest"), "left")
    return joined.drop("_digest")


def stitch(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Requests with their stored responses by item_id and chunk_no; null where there is none."""
    return requests.join(responses.select("item_id", "chunk_no", "response", "error"), ["item_id", "chunk_no"], "left")


def filter_requests(items: DataFrame, template: str) -> DataFrame:
    """(item_id, prompt, body): shall this title be kept? items: item_id, title, author."""
    prompt = X.build_prompt(F.lit(template), title=F.col("title"), author=F.col("author"))
    return items.select("item_id", prompt.alias("prompt")).withColumn("body", X.request_json("filter", F.col("prompt"), F.col("prompt")))


def speaker_requests(documents: DataFrame, template: str) -> DataFrame:
    """(item_id, prompt): who speaks? documents: item_id, title, author, body."""
    return documents.select("item_id", X.build_prompt(F.lit(template), text=X.truncate_sample(F.col("body")), title=F.col("title"), author=F.col("author")).alias("prompt"))


def chunk_requests(documents: DataFrame, template: str, hint: str = "", extra: str = "") -> DataFrame:
    """(item_id, chunk_no, chunk_text, prompt): documents: item_id, title, author, body, language, names map."""
    chunks = documents.select("*", F.posexplode(turns.pack_chunks(F.col("body"))).alias("chunk_no", "chunk_text"))
    bilingual = F.when(X.needs_bilingual(F.col("language"), True), extra).otherwise("")
    prompt = X.build_prompt(F.lit(template), text=F.col("chunk_text"), title=F.col("title"), author=F.col("author"), speaker_map=X.speaker_info_text(F.col("names")), language_hint=F.lit(hint), extra_instructions=bilingual)
    return chunks.select("item_id", "chunk_no", "chunk_text", prompt.alias("prompt"))


def correct_documents(documents: DataFrame, answered: DataFrame) -> DataFrame:
    """(item_id, corrected): accepted chunks in order, names put in, tags and inventions cleaned.

    documents: item_id, names map; answered: item_id, chunk_no, chunk_text, response.
    """
    accepted = X.accept_chunk(F.col("chunk_text"), X.strip_think(F.col("response")))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("chunk_no", accepted.alias("t")))), lambda s: s["t"])
    joined = answered.groupBy("item_id").agg(F.array_join(parts, "\n\n").alias("joined"))
    text = X.collapse_repeated_tags(F.col("joined"))
    text = F.when(F.size("names") > 0, X.collapse_repeated_tags(X.replace_speaker_tags(text, F.col("names")), False)).otherwise(text)
    return documents.select("item_id", "names").join(joined, "item_id").select("item_id", X.strip_hallucinations(text).alias("corrected"))


def summarize_documents(documents: DataFrame, answered: DataFrame) -> DataFrame:
    """(item_id, summary, is_short, is_error, final_md): documents: item_id, title, author, corrected; answered: item_id, response, error."""
    rows = documents.join(answered.select("item_id", X.strip_think(F.col("response")).alias("response"), "error"), "item_id", "left")
    rows = rows.withColumn("s", X.accept_summary(F.col("corrected"), F.col("response"), F.col("error")))
    return rows.select("item_id", "s.*", publish.final_markdown(F.col("title"), F.col("author"), F.col("s.summary"), F.col("corrected")).alias("final_md"))


def process_transcripts(documents: DataFrame, respond: Callable[[str], str], correct: str, summarize: str) -> DataFrame:
    """(item_id, title, author, corrected, summary): correction, then summary, with one caller's function."""
    answered = infer(chunk_requests(documents, correct), respond)
    corrected = documents.select("item_id", "title", "author").join(correct_documents(documents, answered), "item_id")
    asked = corrected.select("item_id", X.build_prompt(F.lit(summarize), text=F.col("corrected"), title=F.col("title"), author=F.col("author")).alias("prompt"))
    return corrected.join(summarize_documents(corrected, infer(asked, respond)).select("item_id", "summary"), "item_id")
