"""Scorers, summaries and model calls: pluggable, batched, with a deterministic stand-in for each."""

from __future__ import annotations

import math
import time
from collections import Counter, deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import shared
from ..functions import labels
from ..functions import text as X

# Texts that stand where no summary can.
EMPTY_TEXT = "El texto de entrada está vacío."
NO_SUMMARY = "resumen no disponible"
FAILED = "error"


# --- look-ups that model calls need


def with_parent_text(comments: DataFrame, said: str = "text") -> DataFrame:
    """``parent_text`` of the comment replied to (or the parent's other column ``said``); of a repeated id the first row counts; null where there is none."""
    name = f"parent_{said}"
    parents = comments.groupBy(F.col("comment_id").alias("_parent")).agg(F.min_by(said, "row_pos").alias(name))
    answers = F.col("reply_to_comment_id").isNotNull()  # the others have no key to meet by
    found = comments.where(answers).join(parents, F.col("reply_to_comment_id") == F.col("_parent"), "left").drop("_parent")
    return found.unionByName(comments.where(~answers).withColumn(name, F.lit(None).cast(dict(comments.dtypes)[said])))


def with_video_codes(comments: DataFrame, videos: DataFrame) -> DataFrame:
    """The video's classification and polarity; of a repeated video the first row by row_pos counts."""
    first = videos.groupBy("video_id").agg(F.min_by(F.struct("classification", "polarity"), "row_pos").alias("_v"))
    return comments.join(first, "video_id", "left").withColumns({"video_stance": labels.likert_tag(F.col("_v.classification")), "video_mood": labels.polarity_tag(F.col("_v.polarity"))}).drop("_v")


def rolling_tokens(usage: DataFrame, seconds: int = 60) -> DataFrame:
    """Tokens used in the last ``seconds`` up to each row.

    Rows are dealt by stretches of time of that length; each also goes to the
    next stretch, so no task sees the whole table.
    """
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    span = seconds * 1_000_000
    cell = F.floor(at / span)
    rows = usage.select("event_id", "tokens", at.alias("at"), F.explode(F.array(cell, cell + 1)).alias("cell"))
    used = F.sum("tokens").over(Window.partitionBy("cell").orderBy("at").rangeBetween(-span, 0))
    return rows.withColumn("used", used).where(F.floor(F.col("at") / span) == F.col("cell")).select("event_id", "used")


# --- scorers


@dataclass
class StubScorer:
    """A stand-in for a transformer: the label follows from the text's length."""

    max_tokens: int = 128
    names: tuple[str, ...] = ("POS", "NEG", "NEU")

    def __call__(self, texts: list[str]) -> list[str]:
        return [self.names[len(t.split()[: self.max_tokens]) % len(self.names)] for t in texts]


def scored(df: DataFrame, text: str, scorer: Callable[[list[str]], list[str]], key: str = "comment_id") -> DataFrame:
    """``sentiment`` of every non-null text by a batch scorer that each worker unpickles once."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in parts:
            yield pd.DataFrame({key: frame[key], "label": scorer(list(frame[text]))})

    kind = dict(df.dtypes)[key]
    rows = df.where(F.col(text).isNotNull()).select(key, text).mapInPandas(run, f"{key} {kind}, label string")
    return rows.select(key, labels.from_model(F.col("label")).alias("sentiment"))


# The published constants of rule-based valence scoring (Hutto and Gilbert, 2014).
ALPHA = 15.0  # of s / sqrt(s * s + ALPHA)
BOOST, CAPITALS, NEGATION = 0.293, 0.733, -0.74
FADING = (1.0, 0.95, 0.9)  # of a booster one, two and three words before
EXCLAMATION, QUESTION, QUESTIONS = 0.292, 0.18, 0.96
BEFORE_BUT, AFTER_BUT = 0.5, 1.5
BOOSTERS = {"very": 1, "really": 1, "so": 1, "extremely": 1, "totally": 1, "muy": 1, "tan": 1, "super": 1, "totalmente": 1, "demasiado": 1, "slightly": -1, "barely": -1, "somewhat": -1, "poco": -1, "algo": -1, "apenas": -1}
NEGATIONS = frozenset("not no never neither nor without cannot don't doesn't didn't isn't wasn't won't can't nunca ni sin jamás tampoco nada".split())
BUTS = frozenset(("but", "pero"))


def compound(text: str, lexicon: dict[str, float]) -> float:
    """Between -1 and 1: the valences of a text's words, changed by what stands around them.

    A word in capitals (in a text that is not all capitals) and boosters up to three words before weigh more or
    less, a negation there turns the sign, what follows a "but" counts more than what leads to it, and
    exclamation and question marks strengthen the whole.
    """
    raw = [w for x in text.split() if (w := x.strip(".,;:!?¡¿\"()[]{}*…“”«»"))]
    words = [w.lower() for w in raw]
    loud = [w.isupper() and len(w) > 1 for w in raw]
    mixed = any(loud) and not all(loud)
    sign = lambda x: (x > 0) - (x < 0)
    values = []
    for i, word in enumerate(words):
        value = 0.0 if word in BOOSTERS else lexicon.get(word, 0.0)
        if value:
            if mixed and loud[i]:
                value += CAPITALS * sign(value)
            base, factor = sign(value), 1.0
            for k, fading in enumerate(FADING, 1):
                if i < k or words[i - k] in lexicon and words[i - k] not in BOOSTERS and words[i - k] not in NEGATIONS:
                    continue
                boost = BOOSTERS.get(words[i - k], 0) * BOOST
                if boost and mixed and loud[i - k]:
                    boost += CAPITALS * sign(boost)
                value += boost * base * fading
                if words[i - k] in NEGATIONS:
                    factor *= NEGATION
            value *= factor
        values.append(value)
    at = next((i for i, w in enumerate(words) if w in BUTS), None)
    if at is not None:
        values = [v * (BEFORE_BUT if i < at else AFTER_BUT if i > at else 1) for i, v in enumerate(values)]
    total = sum(values)
    asked = text.count("?")
    total += sign(total) * (EXCLAMATION * min(text.count("!"), 4) + (0.0 if asked < 2 else QUESTION * asked if asked < 4 else QUESTIONS))
    return total / float(np.sqrt(total * total + ALPHA))


def lexicon_sentiment(df: DataFrame, lexicon: dict[str, float], key: str = "doc_id", text: str = "text") -> DataFrame:
    """``compound`` of every text (null as empty), rounded to four places as published, and its label; the lexicon is sent to every worker."""
    sent = df.sparkSession.sparkContext.broadcast(lexicon)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in parts:
            yield pd.DataFrame({key: frame[key], "compound": [round(compound(t or "", sent.value), 4) for t in frame[text]]})

    rows = df.select(key, text).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, compound double")
    return rows.select(key, "compound", labels.from_compound(F.col("compound")).alias("sentiment"))


# --- summaries

SENTENCE, WORD = r"[^.!?\n]+[.!?]*", r"[\p{L}\p{N}_]+"
_SENTENCE, _WORD = regex.compile(SENTENCE), regex.compile(WORD)
BLANKS = " \t\r\x0b\x0c"


def lsa_sentences(text: str, n: int = 5) -> str:
    """The ``n`` sentences with the longest vectors in latent-semantic space, in document order.

    A term of a sentence weighs 0.4 + 0.6 times its count over that of the sentence's most frequent term.  All
    dimensions are kept, and there a sentence's length, the root of the sum of (singular value * component)^2, is
    the length of its own column: A = U S V' and U only turns.  So no matrix is built, however long the text.
    """
    if not text.strip():
        return EMPTY_TEXT
    sentences = [s for x in _SENTENCE.findall(text) if (s := x.strip(BLANKS))]
    if len(sentences) <= n:
        return " ".join(sentences)
    rank = []
    for s in sentences:
        counts = Counter(_WORD.findall(s.lower()))
        most = max(counts.values(), default=1)
        rank.append(-round(math.sqrt(math.fsum((0.4 + 0.6 * c / most) ** 2 for c in counts.values())), 9))
    chosen = sorted(sorted(range(len(sentences)), key=lambda i: (rank[i], i))[:n])
    return " ".join(sentences[i] for i in chosen)


def summarised(df: DataFrame, text: str, key: str = "doc_id", n: int = 5) -> DataFrame:
    """``summary`` of every text; a failure on one text leaves the fixed message there."""

    def one(value: str | None) -> str:
        try:
            return lsa_sentences(value or "", n)
        except Exception:  # a summariser must not end the job for one text
            return NO_SUMMARY

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in parts:
            yield pd.DataFrame({key: frame[key], "summary": [one(t) for t in frame[text]]})

    return df.select(key, text).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, summary string")


def summaries(videos: DataFrame, transcripts: DataFrame, n: int = 5) -> DataFrame:
    """Videos (video_id, summary, ...) with a summary of their transcript where they have none; without a transcript the fixed message."""
    missing = videos.where(F.col("summary").isNull()).select("video_id").distinct()
    texts = missing.join(transcripts, "video_id", "left").select("video_id", F.when(F.col("snippets").isNotNull(), X.transcript_text(F.col("snippets"))).alias("said"))
    some = summarised(texts.where("said is not null"), "said", "video_id", n)
    made = some.unionByName(texts.where("said is null").select("video_id", F.lit(NO_SUMMARY).alias("summary"))).withColumnRenamed("summary", "_made")
    return videos.join(made, "video_id", "left").withColumn("summary", F.coalesce("summary", "_made")).drop("_made")


# --- model calls


@dataclass
class TokenWindow:
    """At most ``budget`` tokens in any ``seconds``; a single larger call waits for an empty window."""

    budget: int = 450_000
    seconds: float = 60.0
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    used: deque = field(default_factory=deque)
    total: int = 0  # of what is used

    def _forget(self) -> int:
        while self.used and self.clock() - self.used[0][0] >= self.seconds:
            self.total -= self.used.popleft()[1]
        return self.total

    def wait(self, tokens: int) -> None:
        while self._forget() + tokens > self.budget and self.used:
            self.sleep(max(0.0, self.seconds - (self.clock() - self.used[0][0])))

    def spend(self, tokens: int) -> None:
        self.used.append((self.clock(), tokens))
        self.total += tokens


def retried(call: Callable[[], tuple[str, int]], attempts: int = 6, low: float = 5.0, high: float = 60.0, sleep: Callable[[float], None] = time.sleep, seed: int = 0) -> tuple[str | None, int]:
    """The call's answer; after each failure a random, growing wait; (None, 0) after the last."""
    rng = None
    for k in range(attempts):
        try:
            return call()
        except Exception:
            if k + 1 < attempts:
                rng = rng or np.random.Generator(np.random.PCG64(seed))
                sleep(float(rng.uniform(low, min(high, low * 2 ** (k + 1)))))
    return None, 0


def classified(prompts: DataFrame, client: Callable[[str, str], tuple[str, int]], key: str, estimate: int = 800, budget: int = 450_000, attempts: int = 6, sleep: Callable[[float], None] = time.sleep, lanes: int = 8) -> DataFrame:
    """(key, classification, polarity) of rows (key, prompt, message); what fails or does not parse is 'error'.

    All calls go through ``lanes`` tasks, each with its share of the budget, so the
    budget holds whatever runs when; with a budget of few calls there are fewer lanes.
    """
    lanes = max(1, min(lanes, budget // max(1, estimate)))
    share = budget // lanes

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        window = TokenWindow(share, sleep=sleep)
        for frame in parts:
            out = []
            for prompt, message in zip(frame["prompt"], frame["message"], strict=True):
                window.wait(estimate)
                answer, tokens = retried(lambda p=prompt, m=message: client(p, m), attempts, sleep=sleep)
                window.spend(tokens)
                out.append(answer)
            yield pd.DataFrame({key: frame[key], "response": out})

    rows = prompts.select(key, "prompt", "message").repartition(lanes, key).mapInPandas(run, f"{key} {dict(prompts.dtypes)[key]}, response string")
    return rows.select(key, labels.answer(F.col("response")).alias("a")).select(key, "a.*")


def _resumed(work: DataFrame, key: str, results: Callable[[DataFrame], DataFrame], retry: str | None) -> DataFrame:
    """``work`` with classification and polarity; rows that have one keep it (unless it equals ``retry``), the others get ``results``."""
    for c in ("classification", "polarity"):
        work = work if c in work.columns else work.withColumn(c, F.lit(None).cast("string"))
    todo = F.col("classification").isNull() | (F.col("classification") == retry if retry is not None else F.lit(False))
    got = results(work.where(todo).drop("classification", "polarity"))
    return work.where(~todo).unionByName(work.where(todo).drop("classification", "polarity").join(got, key, "left").select(work.columns))


def classified_videos(videos: DataFrame, client, context: str, subject: str, retry: str | None = None, **options) -> DataFrame:
    """Videos (video_id, summary, ...) with classification and polarity of their summaries; what is classified already stays."""

    def results(todo: DataFrame) -> DataFrame:
        asked = todo.select("video_id", F.lit(labels.video_prompt(context, subject)).alias("prompt"), F.col("summary").alias("message")).dropDuplicates(["video_id"])
        return classified(asked, client, "video_id", **{"estimate": 1500} | options)

    return _resumed(videos, "video_id", results, retry)


def comment_prompts(comments: DataFrame, videos: DataFrame, context: str, subject: str) -> DataFrame:
    """(comment_id, prompt, message): the video's codes and, for a reply, the parent's text are part of the question."""
    found = with_video_codes(with_parent_text(comments), videos)
    prompt = labels.comment_prompt(context, subject, F.col("video_stance"), F.col("video_mood"), F.col("parent_text"))
    return found.select("comment_id", prompt.alias("prompt"), F.col("text").alias("message"))


BLOCK = 64  # texts that follow each other in text_id; a cell holds those of two blocks at most, besides frequent ones
FREQUENT = 5_000  # comments from which a text goes to all cells that need it


def _cells(asked: DataFrame) -> DataFrame:
    """``asked`` (text_id, parent_text_id, ...) with the cell in which a comment meets its own text and its parent's.

    A cell is named by the blocks of the two; most comments and their parents share a block where text_ids follow
    the threads.  Texts of very many comments have no block: they are few and go wherever they are needed.
    """
    every = asked.select("text_id").unionByName(asked.where("parent_text_id is not null").select(F.col("parent_text_id").alias("text_id")))
    frequent = shared.durable(every.groupBy("text_id").agg(F.count("*").alias("n")).where(F.col("n") > FREQUENT).select("text_id"), "frequent-texts")
    known = lambda name: F.broadcast(frequent.select(F.col("text_id").alias(name), F.lit(True).alias(f"_{name}")))  # noqa: E731  at most one for FREQUENT comments
    block = lambda name: F.when(F.col(f"_{name}").isNull(), F.floor(F.col(name) / BLOCK))
    met = asked.join(known("text_id"), "text_id", "left").join(known("parent_text_id"), "parent_text_id", "left")
    own, other = block("text_id"), block("parent_text_id")
    spread = F.pmod(F.xxhash64("comment_id"), F.lit(64))  # for comments whose texts are all frequent
    cell = F.concat_ws(":", F.coalesce(own, other, -1 - spread), F.when(own != other, other))
    return met.withColumn("cell", cell).drop("_text_id", "_parent_text_id")


def classified_by_text(asked: DataFrame, texts: DataFrame, client: Callable[[str, str], tuple[str, int]], estimate: int = 800, budget: int = 450_000, attempts: int = 6, sleep: Callable[[float], None] = time.sleep, lanes: int = 8) -> DataFrame:
    """``classified`` of comments (comment_id, opening, text_id, parent_text_id) that name their texts; ``texts`` has (text_id, text), each once.

    Each cell of comments gets each text it needs once, ahead of the comments; so no text is sent, or written, for every comment that says it.
    """
    lanes = max(1, min(lanes, budget // max(1, estimate)))
    share = budget // lanes

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        window, cell, held = TokenWindow(share, sleep=sleep), None, {}
        for batch in parts:
            ids, out = [], []
            for where, comment, opening, own, parent, text in zip(*[batch.column(c).to_pylist() for c in ("cell", "comment_id", "opening", "text_id", "parent_text_id", "text")], strict=True):
                if where != cell:
                    cell, held = where, {}
                if opening is None:
                    held[own] = text
                    continue
                question = labels.comment_question(opening, held.get(parent))
                window.wait(estimate)
                answer, tokens = retried(lambda p=question, m=held.get(own): client(p, m), attempts, sleep=sleep)
                window.spend(tokens)
                ids.append(comment)
                out.append(answer)
            yield pa.RecordBatch.from_pydict({"comment_id": pa.array(ids, pa.string()), "response": pa.array(out, pa.string())})

    placed = shared.durable(_cells(asked), "asked-cells")
    needed = placed.select("cell", "text_id").unionByName(placed.where("parent_text_id is not null").select("cell", F.col("parent_text_id").alias("text_id"))).distinct()
    nothing = lambda name, kind="string": F.lit(None).cast(kind).alias(name)
    told = needed.join(texts.select("text_id", "text"), "text_id").select("cell", nothing("comment_id"), nothing("opening"), "text_id", nothing("parent_text_id", "bigint"), "text")
    rows = told.unionByName(placed.select("cell", "comment_id", "opening", "text_id", "parent_text_id", nothing("text")))
    # a cell's texts, which have no opening, come before its comments
    answers = rows.repartition(lanes, "cell").sortWithinPartitions("cell", F.asc_nulls_first("opening")).mapInArrow(run, "comment_id string, response string")
    return answers.select("comment_id", labels.answer(F.col("response")).alias("a")).select("comment_id", "a.*")


def classified_comments(comments: DataFrame, videos: DataFrame, client, context: str, subject: str, retry: str | None = None, texts: DataFrame | None = None, **options) -> DataFrame:
    """Comments with classification and polarity; parents are looked up among all comments, finished ones included.

    With ``texts`` (text_id, text) comments name their text by text_id.
    """

    def results(todo: DataFrame) -> DataFrame:
        these = todo.select("comment_id").distinct()
        if texts is None:
            return classified(comment_prompts(comments, videos, context, subject).join(these, "comment_id", "left_semi").dropDuplicates(["comment_id"]), client, "comment_id", **options)
        found = with_video_codes(with_parent_text(comments, "text_id"), videos)
        asked = found.select("comment_id", labels.comment_opening(context, subject, F.col("video_stance"), F.col("video_mood")).alias("opening"), "text_id", "parent_text_id")
        return classified_by_text(asked.join(these, "comment_id", "left_semi").dropDuplicates(["comment_id"]), texts, client, **options)

    return _resumed(comments, "comment_id", results, retry)
