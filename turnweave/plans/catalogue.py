"""The registered queries and the SQL that must give the same rows."""

from __future__ import annotations

import json
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..backends import punctuate
from ..functions import text as X
from ..functions.times import format_offset
from ..model import SECOND, DedupConfig, PlanConfig, SliceConfig
from ..operators import dialog, intervals, overlap, planning
from ..operators.fold import ordered_fold
from ..session import ship, table
from ..sinks import clean_line, dialog_rows, punctuated, quoted_line, segment_rows, transcript_json, transcript_text
from ..sources.audio import cut
from ..sources.lines import parse_dialog
from ..summary import fold, messages, policy
from ..summary.clients import Digest
from .tables import EVENT_SQL, SPAN_SQL, TURN_SQL, event_segments, turns, user_spans

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}
#: Thresholds for the tables' scale: gaps of minutes and hours where recordings have seconds.
DIALOG_GAP = 600 * SECOND
HOUR = 3600 * SECOND
SLICE = SliceConfig(pad_us=50_000, merge_gap_us=HOUR, target_us=600 * SECOND, overshoot_us=120 * SECOND, limit_us=900 * SECOND, inner_silence_us=6 * HOUR)
PACK = SliceConfig(target_us=9000 * SECOND, overshoot_us=0, limit_us=48 * HOUR, inner_silence_us=6 * HOUR)
PLAN = PlanConfig(target_tokens=200, max_tokens=220)
# White space as DuckDB's regular expressions write it.
WS = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
LABELS = {"user": "Guest", "assistant": "Host"}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


MERGED_SQL = f"""{EVENT_SQL}, f AS (
  SELECT *, CASE WHEN lag(audio) OVER w = audio AND start_us - lag(end_us) OVER w <= {DIALOG_GAP} THEN 0 ELSE 1 END AS opens
  FROM s WHERE text <> '' WINDOW w AS (PARTITION BY dir ORDER BY start_us, seg_no)
), g AS (SELECT *, sum(opens) OVER (PARTITION BY dir ORDER BY start_us, seg_no) AS turn FROM f
), m AS (
  SELECT dir, CAST(turn AS BIGINT) AS turn, min(audio) AS audio, min(start_us) AS start_us, arg_max(end_us, (start_us, seg_no)) AS end_us,
    string_agg(text, ' ' ORDER BY start_us, seg_no) AS text, count(*) AS n_segments FROM g GROUP BY dir, turn
)"""


@query(f"WITH {MERGED_SQL} SELECT * FROM m")
def dialog_merge(spark, sf_dir):
    return dialog.merge_turns(event_segments(spark, sf_dir), DIALOG_GAP)


@query(ORACLE_SQL["dialog_merge"])
def dialog_merge_sliced(spark, sf_dir):
    """The same turns where no session's rows meet in one task: slices of six hours."""
    return dialog.merge_turns(event_segments(spark, sf_dir), DIALOG_GAP, slice_us=6 * HOUR)


@query(f"WITH {MERGED_SQL} SELECT dir, audio, string_agg(text, ' ' ORDER BY turn) AS text, min(turn) AS first_turn FROM m GROUP BY dir, audio")
def dialog_transcript(spark, sf_dir):
    return dialog.transcripts(dialog_merge(spark, sf_dir))


@query(f"""WITH {MERGED_SQL}, r AS (SELECT dir, audio, string_agg(text, ' ' ORDER BY turn) AS text, min(turn) AS n FROM m GROUP BY dir, audio)
SELECT dir, '{{' || chr(10) || string_agg('  "' || audio || '": "' || text || '"', ',' || chr(10) ORDER BY n) || chr(10) || '}}' AS json FROM r GROUP BY dir""")
def transcript_documents(spark, sf_dir):
    return transcript_json(dialog_transcript(spark, sf_dir))


def _user_days(sql: str) -> str:
    """With a user's day as the session: one in ten of those has nothing but silent segments."""
    return sql.replace("'%Y-%m-%d') AS dir", "'%Y-%m-%d') || '/' || user_id AS dir")


@query(f"WITH {_user_days(MERGED_SQL)} SELECT d.dir, turn, audio, start_us, end_us, text, n_segments FROM (SELECT DISTINCT dir FROM s) d LEFT JOIN m ON d.dir = m.dir")
def dialog_sessions(spark, sf_dir):
    segments = event_segments(spark, sf_dir).withColumn("dir", F.concat_ws("/", "dir", "user_id"))
    return dialog.with_empty_dialogs(segments, dialog.merge_turns(segments, DIALOG_GAP))


PADDED_SQL = SPAN_SQL + """, tot AS (SELECT user_id, max(end_us) AS total FROM u GROUP BY user_id), p AS (
  SELECT user_id, greatest(0, start_us - 50000) AS start_us, least(total, end_us + 50000) AS end_us FROM u JOIN tot USING (user_id))"""


def _padded(spark, sf_dir):
    spans = user_spans(spark, sf_dir)
    totals = spans.groupBy("user_id").agg(F.max("end_us").alias("total"))
    return intervals.pad(spans.join(totals, "user_id"), 50_000, "total").select("user_id", "start_us", "end_us")


@query(f"WITH {PADDED_SQL} SELECT * FROM p")
def interval_pad(spark, sf_dir):
    return _padded(spark, sf_dir)


def _merge_sql(source: str, gap: int, name: str) -> str:
    return f"""{name}_f AS (SELECT *, CASE WHEN start_us - max(end_us) OVER (PARTITION BY user_id ORDER BY start_us, end_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < {gap} THEN 0 ELSE 1 END AS opens FROM {source}
), {name}_g AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY start_us, end_us ROWS UNBOUNDED PRECEDING) AS island FROM {name}_f
), {name} AS (SELECT user_id, min(start_us) AS start_us, max(end_us) AS end_us FROM {name}_g GROUP BY user_id, island)"""


@query(f"WITH {PADDED_SQL}, {_merge_sql('p', HOUR, 'm')} SELECT * FROM m")
def interval_merge_close(spark, sf_dir):
    return intervals.merge_close(_padded(spark, sf_dir), ["user_id"], HOUR)


@query(ORACLE_SQL["interval_merge_close"])
def interval_merge_sliced(spark, sf_dir):
    """The same spans where no recording's rows meet in one task: slices of a day."""
    return intervals.merge_close(_padded(spark, sf_dir), ["user_id"], HOUR, slice_us=24 * HOUR)


def _split_sql(source: str, limit: int, width: int, name: str) -> str:
    return f"""{name} AS (SELECT user_id, k AS start_us, CASE WHEN e - b > {limit} THEN least(k + {width}, e) ELSE e END AS end_us FROM (
  SELECT user_id, start_us AS b, end_us AS e, unnest(CASE WHEN end_us - start_us > {limit} THEN generate_series(start_us, end_us - 1, {width}) ELSE [start_us] END) AS k FROM {source}))"""


@query(f"WITH {SPAN_SQL}, {_split_sql('u', 1200 * SECOND, 900 * SECOND, 'c')} SELECT * FROM c")
def interval_split_long(spark, sf_dir):
    return intervals.split_long(user_spans(spark, sf_dir), 1200 * SECOND, 900 * SECOND)


@query(f"WITH {SPAN_SQL}, {_split_sql('u', 600 * SECOND, 600 * SECOND, 'c')} SELECT * FROM c")
def vad_split(spark, sf_dir):
    return intervals.split_long(user_spans(spark, sf_dir), 600 * SECOND)


def _pack_sql(source: str, c: SliceConfig, name: str) -> str:
    return f"""{name}_n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY start_us, end_us) AS rn FROM {source}
), {name}_r AS (
  SELECT user_id, rn, start_us AS b, start_us, end_us, end_us - start_us AS speech, 1 AS bin FROM {name}_n WHERE rn = 1
  UNION ALL
  SELECT n.user_id, n.rn, CASE WHEN x THEN n.start_us ELSE b END, n.start_us, n.end_us, CASE WHEN x THEN 0 ELSE speech END + n.end_us - n.start_us, bin + x::INT FROM (
    SELECT n.*, r.b, r.speech, r.bin, n.start_us - r.end_us > {c.inner_silence_us} OR r.speech + n.end_us - n.start_us > {c.speech_cap_us} OR n.end_us - r.b > {c.limit_us} AS x
    FROM {name}_r r JOIN {name}_n n ON n.user_id = r.user_id AND n.rn = r.rn + 1) n
), {name} AS (SELECT user_id, min(start_us) AS start_us, arg_max(end_us, rn) AS end_us, CAST(sum(end_us - start_us) AS BIGINT) AS speech_us, count(*) AS n_spans FROM {name}_r GROUP BY user_id, bin)"""


@query(f"WITH RECURSIVE {SPAN_SQL}, {_pack_sql('u', PACK, 'k')} SELECT * FROM k")
def interval_pack_bins(spark, sf_dir):
    return intervals.pack_bins(user_spans(spark, sf_dir), ["user_id"], PACK)


def _half_even(n: str, d: int) -> str:
    return f"(({n}) // {d} + CASE WHEN 2 * (({n}) % {d}) > {d} OR 2 * (({n}) % {d}) = {d} AND ({n}) // {d} % 2 = 1 THEN 1 ELSE 0 END)"


def _clamp_sql(source: str, limit: int, name: str) -> str:
    return f"""{name}_s AS (SELECT user_id, {_half_even('start_us * 2', 125)} AS a, greatest({_half_even('start_us * 2', 125)} + 1, {_half_even('end_us * 2', 125)}) AS z FROM {source}
), {name} AS (SELECT user_id, k AS start_sample, least(k + {limit}, z) AS end_sample FROM (SELECT *, unnest(generate_series(a, z - 1, {limit})) AS k FROM {name}_s))"""


SLICE_SQL = f"""{PADDED_SQL}, {_merge_sql('p', SLICE.merge_gap_us, 'm')}, {_split_sql('m', SLICE.limit_us, SLICE.target_us, 'c')}"""


@query(f"WITH RECURSIVE {SLICE_SQL}, {_pack_sql('c', SLICE, 'k')}, {_clamp_sql('k', SLICE.limit_us * 16 // 1000, 'z')} SELECT * FROM z")
def slice_pipeline(spark, sf_dir):
    spans = user_spans(spark, sf_dir)
    totals = spans.groupBy("user_id").agg(F.max("end_us").alias("total"))
    return intervals.slice_speech(spans.join(totals, "user_id"), ["user_id"], SLICE, "total")


@query(f"WITH {SPAN_SQL}, {_clamp_sql('u', 500 * 16000, 'z')} SELECT * FROM z")
def interval_samples(spark, sf_dir):
    return intervals.clamp_samples(intervals.spans_to_samples(user_spans(spark, sf_dir)), 500 * SECOND)


def _offset_sql(us: str) -> str:
    ms = _half_even(f"greatest({us}, 0)", 1000)
    return f"printf('%02d:%02d:%02d.%03d', {ms} // 3600000, {ms} // 60000 % 60, {ms} // 1000 % 60, {ms} % 1000)"


@query(f"WITH {EVENT_SQL} SELECT seg_no, {_offset_sql('start_us - 1704067200000000')} AS start, {_offset_sql('end_us - 1704067200000500')} AS end FROM s")
def format_timestamp(spark, sf_dir):
    s = event_segments(spark, sf_dir)
    return s.select("seg_no", format_offset(F.col("start_us") - 1704067200000000).alias("start"), format_offset(F.col("end_us") - 1704067200000500).alias("end"))


@query(f"WITH {EVENT_SQL} SELECT seg_no, audio, {_offset_sql('start_us')} AS start, {_offset_sql('end_us')} AS end, (end_us - start_us) / 1e6 AS duration, text FROM s")
def segment_export(spark, sf_dir):
    return segment_rows(event_segments(spark, sf_dir), "seg_no")


@query(f"WITH {MERGED_SQL} SELECT dir, turn, audio, {_offset_sql('start_us')} AS start, {_offset_sql('end_us')} AS end, text FROM m")
def dialog_export(spark, sf_dir):
    return dialog_rows(dialog_merge(spark, sf_dir), "dir", "turn")


@query(f"WITH {MERGED_SQL} SELECT dir, audio, audio || chr(10) || string_agg(text, ' ' ORDER BY turn) || chr(10) || chr(10) AS block FROM m GROUP BY dir, audio")
def transcript_blocks(spark, sf_dir):
    return transcript_text(dialog_transcript(spark, sf_dir)).select("dir", "audio", "block")


@query(f"WITH {EVENT_SQL} SELECT seg_no, printf('%.1f-%.1f Голос', (start_us % 100000000000) / 1e6, (end_us % 100000000000) / 1e6) AS line FROM s")
def report_lines(spark, sf_dir):
    s = event_segments(spark, sf_dir)
    return intervals.report(s.select("seg_no", (F.col("start_us") % 100_000_000_000).alias("start_us"), (F.col("end_us") % 100_000_000_000).alias("end_us"))).select("seg_no", "line")


#: A recording of 16-bit samples for each user: the numbers from 0 on, as many as the user has milliseconds of speech.
_CLIPPED = 16 * SECOND


@query(f"""WITH {SPAN_SQL}, c AS (SELECT user_id, start_us % {_CLIPPED} AS a, start_us % {_CLIPPED} + (end_us - start_us) % {_CLIPPED} AS z FROM u),
q AS (SELECT DISTINCT user_id, a * 2 // 125 AS a, z * 2 // 125 AS z FROM c WHERE z * 2 // 125 > a * 2 // 125)
SELECT user_id, a AS start_sample, z AS end_sample, CAST(2 * greatest(0, least(z, 256000) - least(a, 256000)) AS BIGINT) AS n_bytes,
  upper(substr(md5(CAST(user_id AS VARCHAR)), 1 + 2 * CAST(a % 16 AS INTEGER), 2)) AS first_byte FROM q WHERE a < 256000""")
def chunk_cut(spark, sf_dir):
    """Chunks cut from 16 seconds of bytes; a chunk that goes beyond the end is clipped there."""
    spans = user_spans(spark, sf_dir).select("user_id", (F.col("start_us") % _CLIPPED).alias("a"), ((F.col("end_us") - F.col("start_us")) % _CLIPPED).alias("d"))
    sample = lambda c: F.expr(f"({c}) * 2 div 125")
    chunks = spans.select("user_id", sample("a").alias("start_sample"), sample("a + d").alias("end_sample")).filter("end_sample > start_sample").distinct()
    both = F.concat(*[F.repeat(F.substring(F.md5(F.col("user_id").cast("string").cast("binary")), 1 + 2 * k, 2), 2) for k in range(16)])
    waves = chunks.select("user_id").distinct().select("user_id", F.repeat(F.unhex(both).cast("string"), 16000).cast("binary").alias("pcm"))
    clipped = cut(waves, chunks.filter("start_sample < 256000"), "user_id")
    return clipped.select("user_id", "start_sample", "end_sample", F.octet_length("pcm").cast("long").alias("n_bytes"), F.hex(F.substring("pcm", 1, 1)).alias("first_byte"))


_NAME_SQL = "CASE turn % 4 WHEN 0 THEN 'out/' || role || '.wav' WHEN 1 THEN upper(role) || '.MP3' WHEN 2 THEN 'guest' || conv_id || '.wav' ELSE '' END"


@query(f"""WITH n AS (SELECT conv_id, turn, {_NAME_SQL} AS audio FROM conversations),
p AS (SELECT *, regexp_extract(audio, '[^/]*$') AS name FROM n), q AS (SELECT *, regexp_replace(name, '\\.[^.]*$', '') AS stem FROM p)
SELECT conv_id, turn, audio, CASE lower(stem) WHEN 'user' THEN 'Guest' WHEN 'assistant' THEN 'Host' ELSE coalesce(nullif(stem, ''), nullif(name, ''), 'audio') END AS speaker FROM q""")
def speaker_label(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(_NAME_SQL).alias("audio"))
    return rows.withColumn("speaker", dialog.speaker_label(F.col("audio"), LABELS))


@query(ORACLE_SQL["speaker_label"])
def speaker_label_joined(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(_NAME_SQL).alias("audio"))
    labels = spark.createDataFrame(list(LABELS.items()), "key string, label string")
    return dialog.label_speakers(rows, labels)


@query(f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, greatest(n_chars, 0) * 250000 AS us FROM documents),
w AS (SELECT *, len(list_filter(string_split_regex(text, '{WS}+'), lambda x: x <> '')) AS n_words, greatest(us, 0.001) AS d FROM d)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, text <> '' AND (n_words * 1e6 >= d OR length(text) * 1e6 >= 4.5 * d) AS dense FROM w""")
def text_density(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    dense = X.is_dense(text, F.greatest("n_chars", F.lit(0)) * 250_000, DedupConfig(min_chars_per_s=4.5))
    return table(spark, sf_dir, "documents").select("doc_id", X.word_count(text).cast("long").alias("n_words"), dense.alias("dense"))


#: Words with compatibility characters, put behind every tenth text, and what these stand for (DuckDB only composes).
_COMPATIBLE = {"ﬁne": "fine", "Ⅳ x²": "IV x2", "ｆｕｌｌ１": "full1", "①ﬂ…": "1fl...", "ĳ ŉ": "ij ʼn"}
_STANDS_FOR = ", ".join(f"'{x}'" for x in _COMPATIBLE.values())


@query(f"""SELECT doc_id, array_to_string(list_filter(string_split_regex(lower(regexp_replace(nfc_normalize(coalesce(text, '') || CASE WHEN doc_id % 10 = 0 THEN ' ' || [{_STANDS_FOR}][doc_id // 10 % {len(_COMPATIBLE)} + 1] ELSE '' END), '[^\\p{{L}}\\p{{N}}_\\s\\x0B\\x1C-\\x1F\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]', '', 'g')), '{WS}+'), lambda x: x <> ''), ' ') AS tokens FROM documents""")
def text_norm_tokens(spark, sf_dir):
    behind = F.get(F.array(*[F.lit(x) for x in _COMPATIBLE]), F.expr(f"CAST(doc_id div 10 % {len(_COMPATIBLE)} AS INT)"))
    text = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit(" "), behind)).otherwise(""))
    return table(spark, sf_dir, "documents").select("doc_id", X.norm_text(text).alias("tokens"))


@query()
def dedup_tail(spark, sf_dir):
    """Conversations whose turns each begin with the last turn's last 20 words."""
    t = turns(spark, sf_dir)
    from pyspark.sql import Window

    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("index"))
    words = X.words(F.coalesce(before, F.lit("")))
    tail = F.array_join(F.slice(words, F.greatest(F.lit(1), F.size(words) - 19), F.lit(20)), " ")
    rows = t.select("conv_id", F.col("index").alias("seg_no"), (F.col("index") * 20 * SECOND).alias("start_us"), ((F.col("index") + 1) * 20 * SECOND).alias("end_us"), F.trim(F.concat(tail, F.lit(" "), F.col("text"))).alias("text"))
    return overlap.drop_overlaps(rows, ["conv_id"], DedupConfig(tail_chars=160))


_SPACED = "regexp_replace(coalesce(text, ''), '([,.;:!?])', ' \\\\1 —', 'g')"


@query(f"""WITH a AS (SELECT doc_id, {_SPACED} AS t FROM documents),
b AS (SELECT doc_id, regexp_replace(t, '^{WS}+|{WS}+$', '', 'g') AS t FROM a), c AS (SELECT doc_id, regexp_replace(t, '{WS}+([,.;:!?…])', '\\1', 'g') AS t FROM b),
d AS (SELECT doc_id, regexp_replace(t, '{WS}+—{WS}*', ' — ', 'g') AS t FROM c), e AS (SELECT doc_id, regexp_replace(t, '{WS}{{2,}}', ' ', 'g') AS t FROM d)
SELECT doc_id, regexp_replace(t, '^{WS}+|{WS}+$', '', 'g') AS fixed FROM e""".replace("\\\\1", "\\1"))
def detok_spaces(spark, sf_dir):
    spaced = F.regexp_replace(F.coalesce("text", F.lit("")), "([,.;:!?])", " $1 —")
    return table(spark, sf_dir, "documents").select("doc_id", X.fix_spaces(spaced).alias("fixed"))


_CASES = ", ".join(f"'{c}'" for c in X.CASES)
_MARKS = ", ".join(f"('{k}', '{v}')" for k, v in X.MARKS.items())


#: Labels of every case and mark, and one that is none; a word takes the one its length and first letter number.
_LABELS = [f"{c}_{m}" for c in X.CASES for m in X.MARKS] + ["OTHER"]


@query(f"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '\\p{{L}}[\\p{{L}}\\p{{M}}]*')) AS token FROM documents), m(mark, sign) AS (VALUES {_MARKS}),
l AS (SELECT token, [{", ".join(f"'{x}'" for x in _LABELS)}][(length(token) * 5 + unicode(token)) % {len(_LABELS)} + 1] AS label FROM w),
p AS (SELECT *, regexp_extract(label, '^(UPPER_TOTAL|UPPER|LOWER)', 1) AS form, regexp_extract(label, '_([A-Z]+)$', 1) AS mark FROM l),
q AS (SELECT token, label, form, mark, CASE form WHEN 'LOWER' THEN token WHEN 'UPPER' THEN CASE WHEN token[1] = 'ß' THEN 'Ss' ELSE upper(token[1]) END || lower(token[2:]) ELSE replace(replace(upper(token), 'ẞ', 'SS'), 'ß', 'SS') END AS shaped FROM p)
SELECT token, label, CASE WHEN label = 'OTHER' THEN token ELSE shaped || CASE WHEN mark = 'TIRE' AND form <> 'LOWER' THEN ' ' ELSE '' END || sign END AS shaped FROM q LEFT JOIN m USING (mark)""")
def token_case(spark, sf_dir):
    """All words of the whole texts: runs of letters of any script, with their combining marks."""
    found = F.regexp_extract_all("text", F.lit(r"(\p{L}[\p{L}\p{M}]*)"), 1)
    words = table(spark, sf_dir, "documents").select(F.explode(found).alias("token")).distinct()
    number = (F.length("token") * 5 + _code_point(F.col("token"))) % len(_LABELS)
    labelled = words.withColumn("label", F.get(F.array(*[F.lit(x) for x in _LABELS]), number.cast("int")))
    return labelled.withColumn("shaped", X.marked(F.col("token"), F.col("label")))


def _code_point(text):
    """Of the first character."""
    return F.conv(F.hex(F.encode(F.left(text, F.lit(1)), "UTF-32")), 16, 10).cast("long")


@query(f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), h AS (SELECT *, substr(t, 1, length(t) // 2) AS a, substr(t, length(t) // 2 + 1) AS b FROM d)
SELECT doc_id, CAST(CASE WHEN length(t) < 2 THEN -1 WHEN regexp_matches(a, '{WS}') THEN length(regexp_extract(a, '(?s)^(.*){WS}[^\\s\\x0B\\x1C-\\x1F\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]*$', 1))
  WHEN regexp_matches(b, '{WS}') THEN length(t) // 2 + length(regexp_extract(b, '(?s)^(.*?){WS}', 1)) ELSE -1 END AS INTEGER) AS at FROM h""")
def text_split_index(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.split_index(F.coalesce("text", F.lit(""))).alias("at"))


@query("SELECT doc_id, CAST(greatest(1, (length(coalesce(text, '')) + 3) // 4) AS BIGINT) AS tokens FROM documents")
def token_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.token_count(F.coalesce("text", F.lit(""))).alias("tokens"))


SIZES_SQL = f"""sz AS (SELECT *, greatest(1, -(-tokens // {PLAN.target_tokens}), least(-(-tokens // {PLAN.max_tokens}), tokens)) AS chunks FROM (
  SELECT conv_id, count(*) AS n_segments, CAST(greatest(1, (sum(length(text)) + 3) // 4) AS BIGINT) AS tokens FROM t GROUP BY conv_id))"""
SIZES_SQL = SIZES_SQL.replace(f"-(-tokens // {PLAN.target_tokens})", f"(tokens + {PLAN.target_tokens - 1}) // {PLAN.target_tokens}").replace(f"-(-tokens // {PLAN.max_tokens})", f"(tokens + {PLAN.max_tokens - 1}) // {PLAN.max_tokens}")


@query(f"WITH {TURN_SQL}, {SIZES_SQL} SELECT conv_id, n_segments, tokens, CAST(chunks AS INTEGER) AS chunks FROM sz")
def chunk_count(spark, sf_dir):
    return planning.token_sizes(turns(spark, sf_dir), ["conv_id"], PLAN)


def _plan_sql(count: str, overlap_: int, name: str) -> str:
    """Windows by recursion: from a window's start to its end by speaker runs, then on."""
    return f"""{name}_n AS (SELECT conv_id, speaker, row_number() OVER (PARTITION BY conv_id ORDER BY idx) - 1 AS pos, count(*) OVER (PARTITION BY conv_id) AS n FROM t
), {name}_e AS (SELECT *, min(stop) OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS run_end FROM (
    SELECT *, CASE WHEN speaker IS DISTINCT FROM lead(speaker) OVER (PARTITION BY conv_id ORDER BY pos) OR pos = n - 1 THEN pos + 1 END AS stop FROM {name}_n)
), {name}_z AS (SELECT conv_id, n, greatest(1, (n + c - 1) // c) AS size FROM (SELECT conv_id, n, ({count}) AS c FROM (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id) q)
), {name}_r AS (
  SELECT z.conv_id, 1 AS chunk, 0 AS a, e.run_end AS b, n, size FROM {name}_z z JOIN (SELECT conv_id, pos, run_end FROM {name}_e) e ON e.conv_id = z.conv_id AND e.pos = least(size, n) - 1
  UNION ALL
  SELECT r.conv_id, chunk + 1, nxt, e.run_end, r.n, size FROM (SELECT *, greatest(0, b - greatest(0, least({overlap_}, size - 1))) AS nxt FROM {name}_r WHERE b < n) r
    JOIN (SELECT conv_id, pos, run_end FROM {name}_e) e ON e.conv_id = r.conv_id AND e.pos = least(nxt + size, r.n) - 1
), {name} AS (SELECT conv_id, CAST(chunk AS BIGINT) AS chunk, CAST(a AS BIGINT) AS seg_from, CAST(b AS BIGINT) AS seg_to FROM {name}_r)"""


@query(f"WITH RECURSIVE {TURN_SQL}, {_plan_sql('3', 1, 'p')} SELECT * FROM p")
def chunk_plan(spark, sf_dir):
    return planning.chunk_plan(turns(spark, sf_dir), ["conv_id"], 3, 1)


@query(f"""WITH RECURSIVE {TURN_SQL}, {_plan_sql('3', 1, 'p')}, cnt AS (SELECT conv_id, (count(*) + 1) // 2 AS c FROM p GROUP BY conv_id),
{_plan_sql('SELECT c FROM cnt WHERE cnt.conv_id = q.conv_id', 1, 'p2')} SELECT * FROM p2""")
def chunk_plan_pass2(spark, sf_dir):
    t = turns(spark, sf_dir)
    return planning.second_pass(t, ["conv_id"], planning.chunk_plan(t, ["conv_id"], 3, 1), 1)


def _turned_sql(count: int, overlap_: int, passes: str, begin: str, name: str) -> str:
    """As ``_plan_sql`` for plans that begin at ``begin`` (of n, size and pass): what lies behind it, then what lies before."""
    return f"""{name}_b AS (SELECT conv_id, n, size, pass, {begin} AS off FROM (SELECT conv_id, n, greatest(1, (n + {count - 1}) // {count}) AS size FROM (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id)) CROSS JOIN (SELECT unnest({passes}) AS pass)
), {name}_n AS (SELECT conv_id, pass, speaker, pos, size, pos < off AS rng FROM (SELECT conv_id, speaker, row_number() OVER (PARTITION BY conv_id ORDER BY idx) - 1 AS pos FROM t) JOIN {name}_b USING (conv_id)
), {name}_e AS (SELECT *, min(stop) OVER (PARTITION BY conv_id, pass, rng ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS run_end FROM (
    SELECT *, CASE WHEN speaker IS DISTINCT FROM lead(speaker) OVER w OR lead(pos) OVER w IS NULL THEN pos + 1 END AS stop FROM {name}_n WINDOW w AS (PARTITION BY conv_id, pass, rng ORDER BY pos))
), {name}_z AS (SELECT conv_id, pass, rng, min(pos) AS lo, max(pos) + 1 AS hi, any_value(size) AS size FROM {name}_n GROUP BY conv_id, pass, rng
), {name}_r AS (
  SELECT z.conv_id, z.pass, z.rng, 1 AS no, lo AS a, e.run_end AS b, lo, hi, z.size FROM {name}_z z JOIN (SELECT conv_id, pass, pos, run_end FROM {name}_e) e ON e.conv_id = z.conv_id AND e.pass = z.pass AND e.pos = least(lo + z.size, hi) - 1
  UNION ALL
  SELECT r.conv_id, r.pass, r.rng, no + 1, nxt, e.run_end, lo, hi, size FROM (SELECT *, greatest(lo, b - greatest(0, least({overlap_}, size - 1))) AS nxt FROM {name}_r WHERE b < hi) r
    JOIN (SELECT conv_id, pass, pos, run_end FROM {name}_e) e ON e.conv_id = r.conv_id AND e.pass = r.pass AND e.pos = least(nxt + size, hi) - 1
), {name} AS (SELECT conv_id, pass, row_number() OVER (PARTITION BY conv_id, pass ORDER BY rng, no) AS chunk, CAST(a AS BIGINT) AS seg_from, CAST(b AS BIGINT) AS seg_to FROM {name}_r)"""


@query(f"WITH RECURSIVE {TURN_SQL}, {_turned_sql(3, 1, '[0]', '2 % n', 'p')} SELECT conv_id, chunk, seg_from, seg_to FROM p")
def chunk_plan_rotated(spark, sf_dir):
    return planning.chunk_plan(turns(spark, sf_dir), ["conv_id"], 3, 1, offset=2)


@query(f"WITH RECURSIVE {TURN_SQL}, {_turned_sql(2, 1, '[0, 1]', 'pass * greatest(1, size // 2) % n', 'p')} SELECT conv_id, CAST(pass AS INTEGER) AS pass, chunk, seg_from, seg_to FROM p")
def chunk_plan_passes(spark, sf_dir):
    return planning.chunk_plans(turns(spark, sf_dir), ["conv_id"], 2, 1, passes=2)


CHUNK_TEXT_SQL = f"""WITH RECURSIVE {TURN_SQL}, {_plan_sql('3', 1, 'p')}, o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY idx) - 1 AS pos FROM t)
SELECT p.conv_id, chunk, count(*) AS n_segments, string_agg('[#' || CASE WHEN idx < 10000 THEN lpad(CAST(idx AS VARCHAR), 4, '0') ELSE CAST(idx AS VARCHAR) END || '] ' || speaker || ': ' || text, chr(10) ORDER BY idx) AS body
FROM p JOIN o ON o.conv_id = p.conv_id AND pos >= seg_from AND pos < seg_to GROUP BY p.conv_id, chunk"""


@query(CHUNK_TEXT_SQL)
def chunk_text(spark, sf_dir):
    t = turns(spark, sf_dir)
    return planning.chunk_texts(t, planning.chunk_plan(t, ["conv_id"], 3, 1), ["conv_id"])


_LINE = """CASE turn % 5 WHEN 0 THEN '{"speaker":"' || role || '","text":' || quoted || ',"start":"00:00:0' || (turn % 10) || '"}'
  WHEN 1 THEN ' ' || role || ' : "' || text || '" ' WHEN 2 THEN '{"audio":"' || role || '.wav","text":' || quoted || '}' WHEN 3 THEN text ELSE '{"text":' || turn || '}' END"""


def _stripped(text: str) -> str:
    return f"regexp_replace({text}, '^{WS}+|{WS}+$', '', 'g')"


@query(f"""WITH q AS (SELECT conv_id, turn AS line_no, turn % 5 AS kind, turn, role, coalesce(text, '') AS text FROM conversations),
l AS (SELECT *, {_stripped('text')} AS whole, instr(text, ':') AS colon FROM q WHERE kind < 4 AND (kind < 3 OR instr(text, ':') > 0)),
b AS (SELECT *, CASE kind WHEN 3 THEN {_stripped("substr(whole, instr(whole, ':') + 1)")} ELSE whole END AS said FROM l),
c AS (SELECT *, {_stripped("CASE WHEN kind = 3 AND said LIKE '\"%\"' AND length(said) > 1 THEN substr(said, 2, length(said) - 2) WHEN kind = 3 AND said = '\"' THEN '' ELSE said END")} AS bare FROM b),
r AS (
  SELECT conv_id, line_no, CASE kind WHEN 2 THEN role || '.wav' WHEN 3 THEN coalesce(nullif({_stripped("substr(whole, 1, instr(whole, ':') - 1)")}, ''), 'Unknown') ELSE role END AS speaker, bare AS text,
    CASE WHEN kind = 2 THEN role || '.wav' END AS audio, CASE WHEN kind = 0 THEN '00:00:0' || (turn % 10) END AS start, CAST(NULL AS VARCHAR) AS stop FROM c WHERE bare <> ''
)
SELECT conv_id, line_no, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY line_no) AS INTEGER) AS index, speaker, text, audio, start, stop AS "end" FROM r""")
def dialog_lines_parse(spark, sf_dir):
    """The whole texts of the conversations, as JSON strings and as they are, colons, quotes and line ends included."""
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", text.alias("text"), X.quoted(text).alias("quoted"))
    return parse_dialog(rows.select("conv_id", F.col("turn").alias("line_no"), F.expr(_LINE).alias("line")), ["conv_id"])


@query(f"""WITH r AS (SELECT role AS audio, turn * 1000 AS start_us, conv_id * 1000 + turn AS line_no, text FROM conversations WHERE regexp_matches(text, '\\S')),
a AS (SELECT audio, string_agg(text, ' ' ORDER BY start_us, line_no) AS t FROM r GROUP BY audio),
b AS (SELECT audio, regexp_replace(t, '^{WS}+|{WS}+$', '', 'g') AS t FROM a), c AS (SELECT audio, regexp_replace(t, '{WS}+([,.;:!?…])', '\\1', 'g') AS t FROM b),
d AS (SELECT audio, regexp_replace(t, '{WS}+—{WS}*', ' — ', 'g') AS t FROM c), e AS (SELECT audio, regexp_replace(t, '{WS}{{2,}}', ' ', 'g') AS t FROM d)
SELECT audio, regexp_replace(t, '^{WS}+|{WS}+$', '', 'g') AS text FROM e""")
def transcript_merge_cli(spark, sf_dir):
    return dialog.punctuated_transcripts(_cli_rows(spark, sf_dir), "text")


def _cli_rows(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(F.col("role").alias("audio"), (F.col("turn") * 1000).alias("start_us"), (F.col("conv_id") * 1000 + F.col("turn")).alias("line_no"), "text")


PUNCTUATED_SQL = f"""w AS (SELECT conv_id, turn, role, text, list_filter(string_split_regex(text, '{WS}+'), lambda x: x <> '') AS w FROM conversations),
a AS (SELECT *, array_to_string(list_transform(w, lambda x, i: CASE WHEN i = 1 THEN upper(x[1]) || lower(x[2:]) ELSE x END || CASE WHEN i = len(w) THEN '.' ELSE '' END), ' ') AS t FROM w),
b AS (SELECT * REPLACE (regexp_replace(t, '^{WS}+|{WS}+$', '', 'g') AS t) FROM a), c AS (SELECT * REPLACE (regexp_replace(t, '{WS}+([,.;:!?…])', '\\1', 'g') AS t) FROM b),
d AS (SELECT * REPLACE (regexp_replace(t, '{WS}+—{WS}*', ' — ', 'g') AS t) FROM c), e AS (SELECT * REPLACE (regexp_replace(regexp_replace(t, '{WS}{{2,}}', ' ', 'g'), '^{WS}+|{WS}+$', '', 'g') AS t) FROM d)"""


@query(f"WITH {PUNCTUATED_SQL} SELECT conv_id, turn, CASE WHEN len(w) = 0 THEN text ELSE t END AS text_punct FROM e")
def punctuate_texts(spark, sf_dir):
    """The rule stand-in's labels: the first word in upper case, a full stop behind the last."""
    return punctuate(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")).select("conv_id", "turn", "text_punct")


@query(f"""WITH {PUNCTUATED_SQL} SELECT conv_id, turn, '{{"audio":"' || role || '","start":' || turn || ', "text_punct": ' || CAST(to_json(CASE WHEN len(w) = 0 THEN text ELSE t END) AS VARCHAR) || '}}' AS line FROM e""")
def punctuated_lines(spark, sf_dir):
    raw = F.expr("""concat(' {"audio":"', role, '","start":', turn, ' } ')""")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", raw.alias("raw"))
    return punctuated(punctuate(rows)).select("conv_id", "turn", "line")


@query("SELECT count(*) AS total, count(*) FILTER (regexp_matches(text, '\\S')) AS non_empty FROM conversations")
def transcript_counters(spark, sf_dir):
    return dialog.counters(_cli_rows(spark, sf_dir), "text")


@query(f"""WITH {TURN_SQL} SELECT conv_id, idx AS index, speaker || ':' || CASE WHEN sq <> '' THEN ' ' || sq ELSE '' END AS clean,
  speaker || ': ' || CAST(to_json(text) AS VARCHAR) AS quoted FROM (SELECT *, trim(regexp_replace(text, '{WS}+', ' ', 'g')) AS sq FROM t)""")
def clean_lines(spark, sf_dir):
    t = turns(spark, sf_dir)
    return t.select("conv_id", "index", clean_line(F.col("speaker"), F.col("text")).alias("clean"), quoted_line(F.col("speaker"), F.col("text")).alias("quoted"))


@query("""WITH f AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '{"transcription":"","text":"t' || doc_id || '"}' WHEN 1 THEN '[{"text":"a' || doc_id || '"},"b"]' WHEN 2 THEN 'plain ' || doc_id ELSE '{"transcript":"x"}' END AS raw FROM documents)
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 't' || doc_id WHEN 1 THEN 'a' || doc_id || ' b' WHEN 2 THEN raw ELSE 'x' END AS text FROM f""")
def recogniser_answers(spark, sf_dir):
    raw = """CASE doc_id % 4 WHEN 0 THEN '{"transcription":"","text":"t' || doc_id || '"}' WHEN 1 THEN '[{"text":"a' || doc_id || '"},"b"]' WHEN 2 THEN 'plain ' || doc_id ELSE '{"transcript":"x"}' END"""
    return table(spark, sf_dir, "documents").select("doc_id", X.recognised(F.expr(raw)).alias("text"))


@query(f"WITH {EVENT_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY md5('42/' || seg_no), seg_no) AS k FROM s) SELECT user_id, seg_no FROM r WHERE k <= 3")
def file_sample(spark, sf_dir):
    return dialog.sample_files(event_segments(spark, sf_dir).select("user_id", "seg_no"), 3, "user_id", "seg_no")


@query(f"""WITH {TURN_SQL} SELECT conv_id, idx AS index, CASE WHEN speaker IN ('user', 'assistant', 'system') THEN speaker ELSE 'user' END AS role,
  trim(text, ' ') || CASE WHEN trim(text, ' ') <> '' THEN chr(10) ELSE '' END || 'end' AS content FROM t""")
def message_content(spark, sf_dir):
    part = lambda text: F.struct(F.lit("text").alias("type"), text.alias("text"))
    m = F.array(F.struct(F.initcap("speaker").alias("role"), F.array(part(F.col("text")), part(F.lit("  ")), part(F.lit(" end "))).alias("content")))
    one = F.get(messages.prepared_column(m), F.lit(0))
    return turns(spark, sf_dir).select("conv_id", "index", one["role"].alias("role"), one["content"].alias("content"))


@query(f"""WITH RECURSIVE {TURN_SQL}, {SIZES_SQL}, {_plan_sql('SELECT chunks FROM sz WHERE sz.conv_id = q.conv_id', 1, 'p')}, cnt AS (SELECT conv_id, (count(*) + 1) // 2 AS c FROM p GROUP BY conv_id),
{_plan_sql('SELECT c FROM cnt WHERE cnt.conv_id = q.conv_id', 1, 'p2')}
SELECT conv_id, CAST(0 AS INTEGER) AS pass, CAST(chunk AS INTEGER) AS chunk, '[dry-run] {messages.Prompts().guide}' AS summary, 'done' AS status FROM p
UNION ALL SELECT conv_id, 1, CAST(chunk AS INTEGER), '[dry-run] {messages.Prompts().guide}', 'done' FROM p2
UNION ALL SELECT DISTINCT conv_id, -1, 0, '[dry-run] [dry-run] {messages.Prompts().guide}', 'done' FROM p""")
def summary_fold_dryrun(spark, sf_dir):
    windows = fold.prompts_of(turns(spark, sf_dir), ["conv_id"], PLAN)
    return fold.summarise(windows, ["conv_id"]).select("conv_id", "pass", "chunk", "summary", "status")


def _told(*parts: str) -> str:
    """SQL of the digest of messages, each a role and an SQL text."""
    return "sha256(" + " || chr(30) || ".join(f"'{r}' || chr(31) || {t}" for r, t in zip(parts[::2], parts[1::2], strict=True)) + ")"


def _prompted_sql(p: messages.Prompts = messages.Prompts()) -> str:
    quote = lambda text: "'" + text.replace("'", "''") + "'"
    system = f"CASE n.pass WHEN 0 THEN {quote(p.system)} ELSE replace({quote(p.second)}, '{{fragment_label}}', n.chunk || '/' || chunks) END"
    user = f"{quote(p.pass_heading)} || CASE n.pass WHEN 0 THEN {quote(p.named(0))} ELSE {quote(p.named(1))} END || ' (' || (n.pass + 1) || '/2)' || chr(10) || chr(10) || {quote(p.summary_heading)} || coalesce(nullif(f.summary, ''), {quote(p.no_summary)})"
    user += f" || chr(10) || chr(10) || {quote(p.fragment_heading)} || n.chunk || '/' || chunks || chr(10) || body || chr(10) || chr(10) || {quote(p.guide)}"
    asked = _told("system", system, "user", user)
    again = _told("assistant", "f.summary", "system", system, "user", user)
    last = _told("system", quote(f"{p.system}\n\n{p.recheck}"), "user", "summary")
    return f"""WITH RECURSIVE {TURN_SQL}, {SIZES_SQL}, {_plan_sql('SELECT chunks FROM sz WHERE sz.conv_id = q.conv_id', 1, 'p')}, cnt AS (SELECT conv_id, (count(*) + 1) // 2 AS c FROM p GROUP BY conv_id),
{_plan_sql('SELECT c FROM cnt WHERE cnt.conv_id = q.conv_id', 1, 'p2')}, o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY idx) - 1 AS pos FROM t),
n AS (SELECT *, count(*) OVER (PARTITION BY conv_id, pass) AS chunks, row_number() OVER (PARTITION BY conv_id ORDER BY pass, chunk) AS k FROM (
  SELECT p.conv_id, pass, chunk, string_agg('[#' || CASE WHEN idx < 10000 THEN lpad(CAST(idx AS VARCHAR), 4, '0') ELSE CAST(idx AS VARCHAR) END || '] ' || speaker || ': ' || text, chr(10) ORDER BY idx) AS body
  FROM (SELECT 0 AS pass, * FROM p UNION ALL SELECT 1, * FROM p2) p JOIN o ON o.conv_id = p.conv_id AND pos >= seg_from AND pos < seg_to GROUP BY p.conv_id, pass, chunk)
), f AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS k, -2 AS pass, CAST(0 AS BIGINT) AS chunk, '' AS summary FROM n
  UNION ALL SELECT n.conv_id, n.k, n.pass, n.chunk, CASE WHEN f.summary = '' THEN {asked} ELSE {again} END FROM f JOIN n ON n.conv_id = f.conv_id AND n.k = f.k + 1
)
SELECT conv_id, CAST(pass AS INTEGER) AS pass, CAST(chunk AS INTEGER) AS chunk, summary, 'done' AS status FROM f WHERE k > 0
UNION ALL SELECT conv_id, -1, 0, {last}, 'done' FROM (SELECT conv_id, arg_max(summary, k) AS summary FROM f GROUP BY conv_id)"""


@query(_prompted_sql())
def summary_fold_digest(spark, sf_dir):
    """Every answer is a digest of the whole prompt, so prompts, order and the running summary all show."""
    windows = fold.prompts_of(turns(spark, sf_dir), ["conv_id"], PLAN)
    return fold.summarise(windows, ["conv_id"], Digest).select("conv_id", "pass", "chunk", "summary", "status")


@query(ORACLE_SQL["summary_fold_digest"])
def summary_fold_resumed(spark, sf_dir):
    """A job that goes on from the first pass of another: the other's rows and its own are those of one job."""
    windows = fold.prompts_of(turns(spark, sf_dir), ["conv_id"], PLAN)
    first = fold.summarise(windows, ["conv_id"], Digest).filter("pass = 0")
    return first.unionByName(fold.summarise(windows, ["conv_id"], Digest, state=first)).select("conv_id", "pass", "chunk", "summary", "status")


@query(f"""WITH m AS (SELECT conv_id, turn, role, {_stripped("coalesce(text, '')")} AS text FROM conversations)
SELECT conv_id, '[' || string_agg('{{"role":"' || CASE role WHEN 'assistant' THEN 'model' ELSE 'user' END || '","parts":[{{"text":' || CAST(to_json(text) AS VARCHAR) || '}}]}}', ',' ORDER BY turn) FILTER (role <> 'system') || ']' AS contents,
  '[' || string_agg('{{"role":"' || role || '","content":' || CAST(to_json(text) AS VARCHAR) || '}}', ',' ORDER BY turn) || ']' AS messages, first(text ORDER BY turn) AS answer FROM m GROUP BY conv_id""")
def chat_payloads(spark, sf_dir):
    """Each conversation as the two providers take it, and its first text read back from an answer of either form."""

    def finish(said):
        write = lambda x: json.dumps(x, ensure_ascii=False, separators=(",", ":"))
        text = messages.plain(said["turns"][0]["content"])
        one = messages.first_candidate({"candidates": [{}, {"content": {"parts": [{"text": "no", "thought": True}, {"text": text}]}}]})
        two = messages.first_choice({"choices": [{"message": {"content": [{"text": text}, {"image": 1}]}}]})
        yield {"conv_id": said["key"], "contents": write(messages.with_instruction(said["turns"])["contents"]), "messages": write(messages.prepared(said["turns"])), "answer": one if one == two else None}

    def step(said, row):
        said["turns"].append({"role": row["speaker"], "content": [{"type": "text", "text": row["text"]}, {"text": " "}]})
        return ()

    schema = T.StructType([T.StructField("conv_id", T.LongType())] + [T.StructField(c, T.StringType()) for c in ("contents", "messages", "answer")])
    return ordered_fold(turns(spark, sf_dir), ["conv_id"], ["index"], schema, lambda key: {"key": key[0], "turns": []}, step, finish)


_RULES = "CASE event_id % 5 WHEN 0 THEN 'off' WHEN 1 THEN 'dynamic' WHEN 2 THEN 'manual' WHEN 3 THEN 'default' ELSE 'auto' END"


@query(f"""WITH e AS (SELECT event_id, event_id % 6 AS attempt, CASE WHEN event_id % 7 < 3 THEN 503 ELSE 500 END AS status, CASE WHEN event_id % 4 = 0 THEN '' ELSE CAST(event_id % 90 AS VARCHAR) END AS header, {_RULES} AS mode FROM events)
SELECT event_id, CASE WHEN status = 503 THEN [60.0, 180.0, 300.0][CAST(least(3, greatest(1, attempt)) AS INTEGER)] ELSE least(30.0, 1.5 * pow(2, greatest(1, attempt) - 1)) END AS delay,
  TRY_CAST(nullif(header, '') AS DOUBLE) AS wait, CASE mode WHEN 'off' THEN 0 WHEN 'manual' THEN event_id + 1 WHEN 'default' THEN NULL ELSE -1 END AS budget,
  CASE event_id % 3 WHEN 0 THEN 'm' || event_id WHEN 1 THEN 'c' || event_id ELSE 'no json ' || event_id END AS problem FROM e""")
def client_rules(spark, sf_dir):
    """Waits without jitter, a provider's wait, thinking budgets and error texts for every event."""

    def rules(batches):
        retry = policy.Retry()
        for batch in batches:
            out = {c: [] for c in ("event_id", "delay", "wait", "budget", "problem")}
            for k, mode in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                status, attempt = 503 if k % 7 < 3 else 500, k % 6
                out["event_id"].append(k)
                out["delay"].append(float(retry.after(503, attempt) if status == 503 else retry.delay(attempt, lambda a, b: 0.0)))
                out["wait"].append(policy.retry_after({"X-RateLimit-Reset": "" if k % 4 == 0 else str(k % 90)}))
                out["budget"].append((policy.thinking(mode, k + 1 if mode == "manual" else None) or {}).get("thinkingBudget"))
                out["problem"].append(policy.error_message((f'{{"error":{{"message":"m{k}","code":1}}}}', f'{{"error":{{"message":"","code":" c{k}"}}}}', f" no json {k}")[k % 3]))
            kinds = {"event_id": pa.int64(), "delay": pa.float64(), "wait": pa.float64(), "budget": pa.int64(), "problem": pa.string()}
            yield pa.RecordBatch.from_arrays([pa.array(out[c], t) for c, t in kinds.items()], names=list(kinds))

    ship(spark)
    return table(spark, sf_dir, "events").selectExpr("event_id", f"{_RULES} AS mode").mapInArrow(rules, "event_id long, delay double, wait double, budget long, problem string")
