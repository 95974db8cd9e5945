"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and
reread as the next stage's docs.  All but the last return the columns of documents.

Edge cases, in every stage: columns may be null and columns beside those of documents are carried
along; an empty table gives an empty table.  Null and empty texts are not toxic (unless the labels
say so of texts without words), are nobody's copy, hold no benchmark item, count no tokens in the mix
and are written as the end id alone.  Repeated rows are copies, of which one stays.

Intermediate tables belong to a stage of a run.  A stage begins when the results of those before it
are written, so it deletes their tables, and only those of its own run; stages that are called without
:func:`run` belong to the run of their thread and folder.
"""

from __future__ import annotations

import threading
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from palisade.llm import decontaminate, jaccard_join, mixing, scratch, token_ids, toxicity
from palisade.llm.registry import tokenizer_file

_run: ContextVar[str] = ContextVar("run", default="")


def _name(sf_dir, k):
    return f"{_run.get() or threading.get_ident()}:{sf_dir}:{k}"


@contextmanager
def _at_work(sf_dir, k):
    for i in range(k):
        scratch.release(_name(sf_dir, i))
    with scratch.owned(_name(sf_dir, k)):
        yield


def drop_toxic(spark, docs, sf_dir):
    """Documents that the toxicity model rejects go."""
    with _at_work(sf_dir, 0):
        model = toxicity.fit(docs, scratch.table(spark, sf_dir, "labels"))
        return toxicity.remove_toxic(docs, model)


def drop_near_copies(spark, docs, sf_dir):
    """One document of each group of near copies stays."""
    with _at_work(sf_dir, 1):
        return jaccard_join.keep_one(docs)


def drop_contaminated(spark, docs, sf_dir):
    """Documents that hold a benchmark item go."""
    with _at_work(sf_dir, 2):
        return decontaminate.remove_contaminated(docs, scratch.table(spark, sf_dir, "benchmark"))


def mix_sources(spark, docs, sf_dir):
    """Sources are mixed to the target weights; a row taken n times stands n times."""
    with _at_work(sf_dir, 3):
        return mixing.apply_mix(docs)


def write_token_ids(spark, docs, sf_dir):
    """Token ids are stored in patched frame-of-reference shards and read back."""
    with _at_work(sf_dir, 4):
        return token_ids.store_and_digest(docs, tokenizer_file())


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token ids", write_token_ids),
]

#: Boosted trees and tokenizers are beyond SQL; the tests hold stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """Apply the stages to documents, each result written and reread."""
    token = _run.set(uuid.uuid4().hex)
    base = f"{scratch.shared_dir(spark)}/palisade-pipeline-{_run.get()}"
    docs = scratch.table(spark, sf_dir, "documents")
    try:
        for i, (_, stage) in enumerate(STAGES):
            stage(spark, docs, sf_dir).write.parquet(f"{base}/{i}")
            docs = spark.read.parquet(f"{base}/{i}")
            if i:
                scratch.delete(spark, f"{base}/{i - 1}")
    finally:  # the shards of the last stage stay
        for i in range(len(STAGES) - 1):
            scratch.release(_name(sf_dir, i))
        _run.reset(token)
    return docs
