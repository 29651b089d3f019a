"""Relational bookkeeping: pages of rows, messages, sessions and what goes with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagework.functions.text import snippet

# Age a session must have before it can lapse; sessions swept at a time.
GRACE = "INTERVAL 5 MINUTES"
SWEEP = 50


def keyset_page(df: DataFrame, limit: int, before: Column | None = None, time: str = "created_at", key: str = "id") -> DataFrame:
    """The newest `limit` rows older than the cursor, with the next cursor: null on a short page."""
    rows = df if before is None else df.filter(F.col(time) < before)
    page = rows.orderBy(F.desc(time), F.desc(key)).limit(limit)
    every = Window.partitionBy()  # at most `limit` rows
    full = F.count("*").over(every) == limit
    return page.withColumn("next_before", F.when(full, F.min(time).over(every)))


def latest(df: DataFrame, limit: int = 50, time: str = "created_at", key: str = "id") -> DataFrame:
    return df.orderBy(F.desc(time), F.desc(key)).limit(limit)


def latest_per_owner(df: DataFrame, owner: str, limit: int = 50, time: str = "created_at", key: str = "id") -> DataFrame:
    """The same for every owner at once; Spark limits each partition before the shuffle."""
    w = Window.partitionBy(owner).orderBy(F.desc(time), F.desc(key))
    return df.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= limit)


def for_taking(questions: DataFrame) -> DataFrame:
    """A test's questions in order, without the answer key."""
    hidden = [c for c in ("correct_answer", "explanation", "source_chunk_id") if c in questions.columns]
    return questions.drop(*hidden).orderBy("test_id", "position")


def messages_with_sources(messages: DataFrame, sources: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Messages with the passages they cite, one row per citation, in time and rank order.

    A message that cites nothing is one row with nulls. Rows rather than lists: a message may
    cite any number of passages.
    """
    cited = (
        sources.join(chunks.select("chunk_id", "document_id", "page_number", F.col("text").alias("__text")), "chunk_id")
        .join(documents.select("document_id", "document_name"), "document_id")
        .select("message_id", "source_rank", "chunk_id", "document_id", "document_name", "page_number", snippet("__text").alias("snippet"))
    )
    return messages.join(cited, "message_id", "left").orderBy("session_id", "created_at", "message_id", "source_rank")


def alive_sources(sources: DataFrame, chunks: DataFrame) -> DataFrame:
    """Citations whose passage still exists."""
    return sources.join(chunks.select("chunk_id"), "chunk_id", "left_semi")


def session_documents(documents: DataFrame, sessions: DataFrame) -> DataFrame:
    """Ready documents of the given sessions: the whole of what those may search."""
    return documents.filter(F.col("status") == "ready").join(sessions.select("session_id"), "session_id", "left_semi")


def live_sessions(tokens: DataFrame, now: Column) -> DataFrame:
    """Sessions with a token that could still be used. One row each, folded before any shuffle."""
    usable = tokens.filter(F.col("revoked_at").isNull() & (F.col("expires_at") > now))
    return usable.select("session_id").distinct()


def expired_sessions(sessions: DataFrame, tokens: DataFrame, now: Column, limit: int | None = None) -> DataFrame:
    """Sessions that ended, or are past the grace period and hold no usable token: all, or the oldest `limit` (a sweep takes `SWEEP`)."""
    live = live_sessions(tokens, now).withColumn("live", F.lit(True))
    old = F.col("created_at") < now - F.expr(GRACE)
    over = sessions.join(live, "session_id", "left").filter(F.col("ended_at").isNotNull() | (old & F.col("live").isNull())).drop("live")
    return over if limit is None else over.orderBy("created_at", "session_id").limit(limit)


def purge_cascade(gone: DataFrame, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """What every table keeps once the sessions in `gone` are removed with all they own.

    `tables` may hold sessions, tokens, users, traces, documents, chunks, chat_sessions, messages,
    message_sources, tests, questions, attempts, answers, card_sets, cards. An owner goes too when none of their sessions
    remain, and their traces with them. Questions and cards that stay lose a source that went; citations of it go.
    """
    kept = dict(tables)
    ended = gone.select("session_id").distinct()

    def drop(name: str, key: str, parents: DataFrame | None) -> None:
        if name in kept and parents is not None:
            kept[name] = kept[name].join(parents.select(key).distinct(), key, "left_anti")

    def lost(name: str, key: str, parents: DataFrame | None, id_: str) -> DataFrame | None:
        if name not in tables or parents is None:
            return None
        return tables[name].join(parents.select(key).distinct(), key, "left_semi").select(id_)

    documents = lost("documents", "session_id", ended, "document_id")
    for name in ("sessions", "tokens", "documents", "chat_sessions", "tests", "card_sets"):
        drop(name, "session_id", ended)
    drop("chunks", "document_id", documents)
    chunks = tables.get("chunks")
    removed = None
    if chunks is not None and "chunk_id" in chunks.columns and documents is not None:
        removed = chunks.join(documents, "document_id", "left_semi").select("chunk_id").distinct()
        drop("message_sources", "chunk_id", removed)
    chats = lost("chat_sessions", "session_id", ended, "chat_id")
    messages = lost("messages", "chat_id", chats, "message_id")
    drop("messages", "chat_id", chats)
    drop("message_sources", "message_id", messages)
    tests = lost("tests", "session_id", ended, "test_id")
    drop("questions", "test_id", tests)
    attempts = lost("attempts", "test_id", tests, "attempt_id")
    drop("attempts", "test_id", tests)
    drop("answers", "attempt_id", attempts)
    drop("cards", "set_id", lost("card_sets", "session_id", ended, "set_id"))
    if removed is not None:
        orphans = removed.select(F.col("chunk_id").alias("source_chunk_id"), F.lit(True).alias("__gone"))
        for name in ("questions", "cards"):
            if name in kept:
                rows = kept[name].join(orphans, "source_chunk_id", "left")
                kept[name] = rows.withColumn("source_chunk_id", F.when(F.col("__gone").isNull(), F.col("source_chunk_id"))).select(*tables[name].columns)
    if "users" in kept and "sessions" in kept:
        emptied = tables["sessions"].select("user_id").distinct().join(kept["sessions"].select("user_id").distinct(), "user_id", "left_anti")
        drop("users", "user_id", emptied)
        drop("traces", "user_id", emptied)
    return kept


def used_chunks(test_questions: DataFrame, tests: DataFrame, cards: DataFrame, card_sets: DataFrame, except_set: str | None = None) -> DataFrame:
    """Per document: chunks earlier tests or card sets drew on, leaving out the set being made."""
    def drawn(items: DataFrame, parents: DataFrame, key: str) -> DataFrame:
        others = parents if except_set is None else parents.filter(F.col(key) != except_set)
        return items.filter(F.col("source_chunk_id").isNotNull()).join(others.select(key, "document_id"), key).select("document_id", F.col("source_chunk_id").alias("chunk_id"))

    return drawn(test_questions, tests, "test_id").union(drawn(cards, card_sets, "set_id")).distinct()


def merge_json(old: Column | str, patch: Column | str) -> Column:
    """Shallow merge of two JSON objects kept as text; null counts as empty."""
    kind = "map<string,variant>"
    as_map = lambda c: F.coalesce(F.from_json(c, kind), F.create_map().cast(kind))
    mine, new = as_map(old), as_map(patch)
    kept = F.map_filter(mine, lambda k, v: ~F.map_contains_key(new, k))
    return F.to_json(F.map_concat(kept, new))
