"""Multi-speaker dialogs and per-speaker transcripts from time-stamped segments.

Segments have ``dir`` (the session), ``audio`` (the speaker's recording), ``start_us``, ``end_us``, ``text``, and tie-breakers
``file_no`` and ``seg_no``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fix_spaces
from ..model import DIALOG_GAP_US

ORDER = ("start_us", "file_no", "seg_no")


def _joined(text: str, order: Sequence[str], separator: str = " ") -> Column:
    """Texts of a group in order. The sort is within the group's own array; ties beyond ``order`` go by the text."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, text))), lambda x: x[text]), separator)


def merge_turns(segments: DataFrame, gap_us: int = DIALOG_GAP_US, key: str = "dir", order: Sequence[str] = ORDER, slice_us: int | None = None) -> DataFrame:
    """Adjacent segments of one ``audio`` at most ``gap_us`` apart become a turn: ``dir, turn, audio, start_us, end_us, text,
    n_segments``.

    Segments without text are left out before adjacency is judged. A turn ends where its last segment ends. No fold is
    needed: a segment opens a turn by its predecessor alone.

    A session is one window partition. Where one may hold a great part of all rows, ``slice_us`` cuts it into slices of
    time: only each slice's last segment and number of turns (a row a slice, combined before the shuffle) are put in
    order over the session, and the rows themselves never meet in one task. ``order`` must then begin with ``start_us``.
    """
    said = segments.filter(F.length("text") > 0)
    numbered = _numbered_by_slice(said, gap_us, key, order, slice_us) if slice_us else _numbered(said, gap_us, key, order)
    last = F.max_by("end_us", F.struct(*order))
    return (
        numbered.groupBy(key, "turn")
        .agg(F.first("audio").alias("audio"), F.min("start_us").alias("start_us"), last.alias("end_us"), _joined("text", order).alias("text"), F.count("*").alias("n_segments"))
        .select(key, "turn", "audio", "start_us", "end_us", "text", "n_segments")
    )


def _opens(before: Column, gap_us: int) -> Column:
    """Whether a segment opens a turn; ``before`` is (audio, end_us) of the one before it, null for the first."""
    goes_on = before["audio"].eqNullSafe(F.col("audio")) & (F.col("start_us") - before["end_us"] <= gap_us)
    return F.when(F.coalesce(before.isNotNull() & goes_on, F.lit(False)), 0).otherwise(1)


def _numbered(said: DataFrame, gap_us: int, key: str, order: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    flagged = said.withColumn("__opens", _opens(F.lag(F.struct("audio", "end_us")).over(w), gap_us))
    return flagged.withColumn("turn", F.sum("__opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def _numbered_by_slice(said: DataFrame, gap_us: int, key: str, order: Sequence[str], slice_us: int) -> DataFrame:
    rows = said.withColumn("__slice", F.floor(F.col("start_us") / F.lit(slice_us)).cast("long"))
    slices = Window.partitionBy("__key").orderBy("__at")
    one = [F.col(key).alias("__key"), F.col("__slice").alias("__at")]
    meets = lambda t: F.col(key).eqNullSafe(t["__key"]) & (F.col("__slice") == t["__at"])
    lasts = rows.groupBy(*one).agg(F.max_by(F.struct("audio", "end_us"), F.struct(*order)).alias("__last"))
    lasts = lasts.select("__key", "__at", F.lag("__last").over(slices).alias("__before"))
    within = Window.partitionBy(key, "__slice").orderBy(*order)
    before = F.coalesce(F.lag(F.struct("audio", "end_us")).over(within), F.col("__before"))
    flagged = rows.join(lasts, meets(lasts)).drop("__key", "__at").withColumn("__opens", _opens(before, gap_us))
    counts = flagged.groupBy(*one).agg(F.sum("__opens").alias("__n"))
    counts = counts.select("__key", "__at", F.coalesce(F.sum("__n").over(slices.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__first"))
    upto = F.sum("__opens").over(within.rowsBetween(Window.unboundedPreceding, 0))
    return flagged.join(counts, meets(counts)).withColumn("turn", F.col("__first") + upto)


def transcripts(turns: DataFrame, key: str = "dir") -> DataFrame:
    """Per recording: its turns' texts in order, and where it first speaks (``first_turn``)."""
    return turns.groupBy(key, "audio").agg(F.trim(_joined("text", ("turn",))).alias("text"), F.min("turn").alias("first_turn"))


def with_empty_dialogs(segments: DataFrame, turns: DataFrame, key: str = "dir") -> DataFrame:
    """The turns, and a row of nulls for each session that has segments but no text. Sessions without segments have none."""
    sessions = segments.select(key).distinct()
    return sessions.join(turns, key, "left").select(*turns.columns)


def _file_name(audio: Column) -> Column:
    """What stands behind the last slash, those at the end aside."""
    return F.element_at(F.split(F.regexp_replace(F.coalesce(audio, F.lit("")), r"[/\\]++$", ""), r"[/\\]"), -1)


def speaker_label(audio: Column, labels: Mapping[str, str]) -> Column:
    """A recording's label: that of its stem, the stem in lower case, the file name or that in lower case, the first that
    has one; else the stem, the name, or ``audio``. ``labels`` is a constant of the job, held in the plan."""
    name = _file_name(audio)
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    known = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv]) if labels else F.create_map().cast("map<string,string>")
    full = lambda c: F.nullif(c, F.lit(""))
    found = [full(F.element_at(known, k)) for k in (stem, F.lower(stem), name, F.lower(name))]
    return F.coalesce(*found, full(stem), full(name), F.lit("audio"))


def label_speakers(turns: DataFrame, labels: DataFrame, audio: str = "audio") -> DataFrame:
    """As ``speaker_label`` with ``labels`` (key, label) as a table of any size: four equi-joins, no broadcast is forced."""
    rows = turns.withColumn("__name", _file_name(F.col(audio)))
    rows = rows.withColumn("__stem", F.regexp_replace("__name", r"(?<=.)\.[^.]*$", ""))
    one = labels.filter(F.length("label") > 0).groupBy("key").agg(F.min("label").alias("label"))
    for k, c in enumerate((F.col("__stem"), F.lower("__stem"), F.col("__name"), F.lower("__name"))):
        rows = rows.withColumn(f"__k{k}", c).join(one.select(F.col("key").alias(f"__k{k}"), F.col("label").alias(f"__l{k}")), f"__k{k}", "left")
    full = lambda c: F.nullif(F.col(c), F.lit(""))
    found = F.coalesce(*[F.col(f"__l{k}") for k in range(4)], full("__stem"), full("__name"), F.lit("audio"))
    return rows.withColumn("speaker", found).select(*turns.columns, "speaker")


def punctuated_transcripts(segments: DataFrame, text: str = "text_punct") -> DataFrame:
    """Per ``audio`` (null: UNKNOWN) its non-blank texts by ``start_us`` (null: 0) and line, spaces put right."""
    rows = segments.select(F.coalesce("audio", F.lit("UNKNOWN")).alias("audio"), F.coalesce("start_us", F.lit(0)).alias("start_us"), "line_no", F.col(text).alias("text"))
    said = rows.filter(F.coalesce(F.col("text").rlike(r"\S"), F.lit(False)))
    return said.groupBy("audio").agg(fix_spaces(_joined("text", ("start_us", "line_no"))).alias("text"))


def counters(segments: DataFrame, text: str = "text_punct") -> DataFrame:
    """One row: texts seen, and those not blank."""
    return segments.agg(F.count("*").alias("total"), F.count_if(F.coalesce(F.col(text).rlike(r"\S"), F.lit(False))).alias("non_empty"))


def sample_files(files: DataFrame, n: int, key: str = "dir", path: str = "path", seed: int = 42) -> DataFrame:
    """``n`` files of each directory, chosen by a seeded hash of their path; all of them if there are no more, or n is 0."""
    if n <= 0:
        return files
    w = Window.partitionBy(key).orderBy(F.md5(F.concat(F.lit(f"{seed}/"), F.col(path).cast("string")).cast("binary")), path)
    return files.withColumn("__place", F.row_number().over(w)).filter(F.col("__place") <= n).drop("__place")
