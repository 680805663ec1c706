"""Corpus pipeline over documents: what the quality rules keep, one document of each near-duplicate group, without benchmark
passages, mixed to the target weights, dealt to shards.

Each stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and returns a DataFrame; all but the last return the
columns of ``docs``, so each can be written and read again before the next. ``run`` applies them to documents and writes
every stage but the last to the cluster's shared folder. A stage begins by removing the tables that the stage before it needed
on the way, unless its ``docs`` still read them.
"""

import functools
import threading

from turnweave.llm import decontam, mixing, quality, sharding, simhash
from turnweave.llm.common import made, materialise, remove, table

_left: dict[int, list[str]] = {}


def _stage(function):
    @functools.wraps(function)
    def staged(spark, docs, sf_dir):
        thread = threading.get_ident()
        remove(spark, _left.pop(thread, []), unless_read_by=docs)
        before = set(made())
        out = function(spark, docs, sf_dir)
        _left[thread] = [p for p in made() if p not in before]
        return out

    return staged


@_stage
def quality_rules(spark, docs, sf_dir):
    """Documents that pass the base rules and the cutoffs certified on the labelled ones; rejected ones go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


@_stage
def near_duplicates(spark, docs, sf_dir):
    """The document of the smallest id of each group of texts that share four fifths of their five-word shingles."""
    return simhash.drop_similar(docs)


@_stage
def decontamination(spark, docs, sf_dir):
    """Documents that hold no 13 words in a row of a benchmark item, however long they are."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


@_stage
def source_mix(spark, docs, sf_dir):
    """Whole documents as often as they begin in the mix: sources above their target lose some, those below it repeat. They lie
    by the shards that the splitting tree deals their blocks to, shuffled within."""
    return mixing.mix_rows(docs)


@_stage
def shards(spark, docs, sf_dir):
    """The mixed documents with the shard (0 to 15) of their id; rows of one id, copies included, share it."""
    return sharding.assign_shards(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-duplicates", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("source mix", source_mix),
    ("shards", shards),
]
#: The fingerprints' hash and the mix's permutation are not in DuckDB; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            before = [p for p in made() if "/turnweave/stage-" in p]
            docs = materialise(out, "stage-" + name.replace(" ", "-"))
            remove(spark, before)  # what the stage read
    return out
